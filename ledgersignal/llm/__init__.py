"""Operators for preparing training text. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Python functions of this folder travel to the executors with the jobs; nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
