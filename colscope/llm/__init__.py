"""Operators of training-data pipelines; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
