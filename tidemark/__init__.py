"""Spark-native analytics for recommender data: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
