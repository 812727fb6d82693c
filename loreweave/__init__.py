"""Knowledge-base and agent-memory analytics as Spark DataFrame jobs.

Every operator takes DataFrames (and plain parameters) and returns a DataFrame.
Nothing here reads the wall clock: operators that depend on time take ``as_of``.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
