"""Operators for preparing training text; nothing outside this folder imports it.

Functions and classes of this package travel with the tasks by value, so executors need
the third-party libraries but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
