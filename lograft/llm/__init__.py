"""Corpus preparation operators for language-model training data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors by value, so that these need no copy of it.
register_pickle_by_value(sys.modules[__name__])
