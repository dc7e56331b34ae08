"""lexweave: document analytics on Spark SQL (normalise, segment, score, group, join, report)."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers are sent by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
