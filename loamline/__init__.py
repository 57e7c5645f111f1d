"""Spark-native analytics for gridded Earth-observation series and the data pipelines around them.

Everything is ``DataFrame -> DataFrame``; compose the functions with ``df.transform``.  NULL is the only
missing value inside the engine: sources turn NaN and fill values into NULL (``loamline.functions.missing``).
"""

__version__ = "0.1.0"
