"""Operators of a training-data pipeline over documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the workers by value: these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
