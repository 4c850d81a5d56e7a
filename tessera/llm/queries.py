"""The operators over whole tables, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown_lm, common, compress_rules, flac, fm_dedup, html_template, jaccard_join, line_dedup, packing, toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(common.read_table(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.perplexity(common.read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(common.read_table(spark, sf_dir, "documents"))


def op5_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup(common.read_table(spark, sf_dir, "documents"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_rules.rules(common.read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(common.read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(common.read_table(spark, sf_dir, "pages"))


def op10_group_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(common.read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_flac_media, op2_toxicity_chain, op3_brown_lm, op4_line_dedup, op5_kk_packing, op6_fm_index_dedup, op7_compression_bands, op8_byte_bpe, op9_html_template, op10_group_jaccard_join)}


#: Words of texts in a row, empty if there are none.
_WORDS = "list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

_WINDOWS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i : i + {fm_dedup.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {fm_dedup.WINDOW - 2})) AS i FROM d WHERE len(w) >= {fm_dedup.WINDOW})),
 first AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {fm_dedup.WINDOW})) AS p FROM win JOIN first USING (k) WHERE struct_pack(d := doc_id, i := i) > f),
 word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

_COMPONENTS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {jaccard_join.SHINGLE - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {jaccard_join.SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {jaccard_join.PERCENT} * (x.n + y.n - c)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result it can tell."""
    return {"op6_fm_index_dedup": _WINDOWS_SQL, "op10_group_jaccard_join": _COMPONENTS_SQL}
