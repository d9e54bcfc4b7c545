"""Operators for the preparation of training data: one module per operator."""

import logtide
from pyspark import cloudpickle

# The package need not be installed where the Python workers run.
cloudpickle.register_pickle_by_value(logtide)
