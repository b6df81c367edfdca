"""lattix: a Spark-native analytics engine for sparse matrices, graphs and large text corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
