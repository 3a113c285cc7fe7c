"""Operators of a training-data pipeline. Nothing else in brindle imports this subpackage.

Its functions and classes are pickled by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
