"""Irregular event tables to analysis-ready trajectories, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their tasks; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
