"""Operators of a training-data pipeline over a documents table.

Code of this package is pickled by value into Python tasks, so executors need no copy of it on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
