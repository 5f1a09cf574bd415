"""Operators for preparing training data: cleaning, deduplication, mixing, scoring and packing.

Functions of this package that run inside tasks are shipped to executors by value, so executors need
not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
