"""Support-ticket analytics as Spark DataFrame operators.

Functions that run in Python workers are pickled by value, so executors need the package neither installed
nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
