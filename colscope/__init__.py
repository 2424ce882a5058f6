"""Column analytics for chart recommendation, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
