"""Foliant: a PySpark-native engine for versioned documents and retrieval over them.

Every operator maps DataFrames to DataFrames; see the README for the map of the package.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
