"""gridloom: mesh and incidence-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors receive the functions of this package by value, so that a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
