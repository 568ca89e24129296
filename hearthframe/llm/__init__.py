"""Operators of a training-data pipeline over document tables.

Python functions of this package travel to executors by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
