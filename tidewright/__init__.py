"""Tidewright: a PySpark-native engine for the decisions, traces and tasks of a distributed runtime."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
