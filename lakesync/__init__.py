"""Spark-native landing, sync, shaping, scoring, and write-back of tabular records."""

import sys

from pyspark import cloudpickle

# Python helpers of this package travel inside the tasks that use them, so
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
