"""Operators of a training-data pipeline: text quality, safety, copies, tokens, languages and archives.

Functions that run in Python workers are pickled by value, so executors need this package neither
installed nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
