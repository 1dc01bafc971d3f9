"""Quire: files and documents as Spark relations.

Functions that run in Python workers are sent by value, so executors need not have
this package installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
