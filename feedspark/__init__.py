"""feedspark: article-recommendation analytics as Spark DataFrame jobs.

Sub-packages
------------
functions  column expressions (text cleaning, URL rules, HTML extraction, vectors, hashing)
sources    table readers, stand-in views over the driver tables, artifact I/O, search source
operators  DataFrame -> DataFrame operators (preparation, profiles, candidates, ranking, metrics, CF)
plans      the named queries (Spark) and their SQL oracles
streaming  the online recommendation entry as a Structured Streaming job
"""

__version__ = "0.1.0"

try:  # ship this package's functions and classes to Python workers by value (no install needed there)
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # without Spark there are no workers to ship to
    pass
