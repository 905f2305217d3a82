"""postloom: a posting pipeline and its analytics, written as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns a lazy DataFrame (or Column).
Nothing in the library collects data, and every clock value is an argument.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
