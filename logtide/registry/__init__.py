"""Every operator as a query over the supplied tables, with its SQL counterpart."""

import logtide
from pyspark import cloudpickle

# The package need not be installed where the Python workers run.
cloudpickle.register_pickle_by_value(logtide)
