"""servops: serving-operations analytics for LLM inference fleets, on Spark.

Every job takes DataFrames and returns DataFrames; Catalyst does the planning.
"""

import sys as _sys

# ship this package's Python code to the workers inside the pickled functions
from pyspark import cloudpickle as _cp

_cp.register_pickle_by_value(_sys.modules[__name__])
