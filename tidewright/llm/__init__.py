"""Operators for training-data pipelines.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so a cluster needs no copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
