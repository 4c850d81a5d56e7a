"""A PySpark-native engine for labelled n-dimensional data."""

from . import algorithms
from .algorithm import Algorithm
from .algorithms import Alignment, BoxcarFilter, ConvolutionFilter, Coregistration, GaussianFilter, NLMeansFilter, OmnibusTest, Reprojection, Resample
from .cube import Cube
from .dataset import Dataset
from .operators.vector import rasterize, read_geojson
from .operators.visual import rgb as to_rgb
from .operators.visual import write_video
from .sources.rasters import auto_merge, map_over_tiles, open_dataset, to_netcdf

__all__ = ["Algorithm", "Alignment", "BoxcarFilter", "ConvolutionFilter", "Coregistration", "Cube", "Dataset", "GaussianFilter", "NLMeansFilter", "OmnibusTest", "Reprojection", "Resample", "algorithms", "auto_merge", "map_over_tiles", "open_dataset", "rasterize", "read_geojson", "to_netcdf", "to_rgb", "write_video"]
