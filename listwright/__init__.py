"""Listings gathered from many sources, deduped, scored, ranked and kept as queryable runs, on Spark."""

import sys

from pyspark import cloudpickle

# functions and classes of this package travel to the executors by value, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
