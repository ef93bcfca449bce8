"""Corporate disclosure-risk analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
