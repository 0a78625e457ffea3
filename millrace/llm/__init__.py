"""Operators for preparing training data; nothing else in the library imports them.

Functions that run on executors are sent there with the task, so that executors
need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
