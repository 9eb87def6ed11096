"""Nested columnar files on Spark: pruned reads, exact nulls, map and fixed-size helpers, metadata and writing."""

import sys

from pyspark import cloudpickle

# Functions and data sources travel to executors by value: they need no installed package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
