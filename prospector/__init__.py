"""A Spark-native engine for finding and evaluating security-relevant changes in version histories."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors whole, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
