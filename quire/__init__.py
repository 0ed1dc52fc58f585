"""Quire: document-corpus analytics on Spark.

Every public operator takes DataFrames and returns DataFrames.  Nothing in the
package collects rows to the driver; the plan is left to Catalyst and AQE.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the workers need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
