"""millrace: a Spark-native data-quality, preprocessing and EDA engine.

Every public operator takes and returns DataFrames (plus, where a decision
needs a handful of scalars, small Python values computed by one aggregate).
"""

__version__ = "0.1.0"
