"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions that run on executors travel there by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
