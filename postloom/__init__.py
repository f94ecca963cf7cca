"""Posting analytics on Spark: DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
