"""The cubes that the registered queries run on, made from whole tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube

NY, NX, NT = 10, 10, 28
EVENT_TYPES = ("click", "view", "purchase", "signup", "logout")

LI = """li AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS y, CAST(l_partkey % 10 AS INTEGER) AS x,
 CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS t,
 avg(l_quantity) AS c11, avg(l_extendedprice) / 1000 AS c22, avg(l_discount) AS c12r, avg(l_tax) AS c12i
 FROM lineitem GROUP BY 1, 2, 3)"""

EV = """ev AS (SELECT CAST(hour(ts) AS INTEGER) AS y, CAST(user_id % 8 AS INTEGER) AS x, event_type AS band,
 avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3)"""

#: Nine means over time make one small image.
IMAGE = "img AS (SELECT y, x, avg(c11) AS c11, avg(c22) AS c22 FROM li GROUP BY y, x)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cube(spark: SparkSession, sf_dir: str) -> Cube:
    t = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    df = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("int").alias("y"), (F.col("l_partkey") % 10).cast("int").alias("x"), t.alias("t"))
    df = df.agg(F.avg("l_quantity").alias("c11"), (F.avg("l_extendedprice") / 1000).alias("c22"), F.avg("l_discount").alias("c12r"), F.avg("l_tax").alias("c12i"))
    return Cube(df, {"y": NY, "x": NX, "t": NT}, ("c11", "c22", "c12r", "c12i"), {"y": (60.0, -10 / 9), "x": (-10.0, 10 / 9), "t": (0.0, 1.0)}, {"crs": 4326})


def image(spark: SparkSession, sf_dir: str) -> Cube:
    return lineitem_cube(spark, sf_dir).select("c11", "c22").reduce("mean", "t")


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("int").alias("y"), (F.col("user_id") % 8).cast("int").alias("x"), F.col("event_type").alias("band")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """Keys as they are, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[r(F.col(c), places).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns if c not in keys])


def r(c: Column, places: int = 6) -> Column:
    """Rounded to a grid by arithmetic, which both engines do alike."""
    return F.floor(c * 10**places + 0.5) / 10**places


def rs(c: str, places: int = 6) -> str:
    return f"floor(({c}) * 1e{places} + 0.5) / 1e{places}"
