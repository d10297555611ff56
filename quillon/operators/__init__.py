"""Operators on DataFrames; functions that tasks run travel with them, so workers need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
