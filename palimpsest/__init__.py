"""Spark-native analytics over short text memories: recall, review, consolidation and reports as DataFrames."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
