"""Spark-native planning, storage and analysis of deterministic training epochs."""

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path, so its functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
