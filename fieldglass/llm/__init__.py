"""Operators for preparing large text corpora. Nothing else in the library imports this subpackage.

Functions that run on executors travel by value, so executors need not have this package on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
