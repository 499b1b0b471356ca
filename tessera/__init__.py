"""Tessera: a Spark-native engine for leakage-controlled question-answering evaluation data.

Every operator takes DataFrames and returns DataFrames.  Nothing is collected
inside an operator except aggregates whose size is bounded by a parameter.
"""

import sys

from pyspark import cloudpickle

# Python stages travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
