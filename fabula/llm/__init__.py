"""Operators for preparing training text; nothing else in fabula imports them.

Functions that run in Python workers travel by value, so a cluster needs only
the third-party libraries (numpy, pyarrow, xxhash, ...) on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
