"""Operators of a large-scale training-data pipeline; nothing else in the library imports them."""
import sys

from pyspark import cloudpickle

# Python tasks get this code with their function, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
