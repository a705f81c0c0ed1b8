"""spantab: Spark operators for tables whose integer target is known up to an interval."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
