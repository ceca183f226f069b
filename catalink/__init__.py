"""Spark-native catalog retrieval, drift detection and SQL audit."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
