"""Operators for preparing language-model training data. Nothing else in the library imports them.

Functions that run in tasks travel with them, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
