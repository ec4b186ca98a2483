"""Operators for preparing training data; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this subpackage with the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
