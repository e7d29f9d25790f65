"""chunkloom: a Spark-native engine for label-scoped chunk search and corpus data processing."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that these needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
