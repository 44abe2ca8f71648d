"""Spark-native checks, features and evaluation for image + table + text datasets."""

import sys

from pyspark import cloudpickle

from sievelight.config import Config, JobConfig

# Send the few worker functions by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config", "JobConfig"]
