"""A PySpark-native engine for a knowledge base of feeds and pages.

Functions for Python workers are sent by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
