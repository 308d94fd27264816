"""Operators of a training-data pipeline over whole document and vector tables."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with them, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
