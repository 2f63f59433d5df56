"""Operators of a training-data pipeline; queries.py registers one query per operator."""

import sys

from pyspark import cloudpickle

# task code travels by value: executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
