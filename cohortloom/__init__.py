"""Cohort-aware signal screening on long, sparse Spark DataFrames."""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
