"""Patchloom: feature learning, linear models and data preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
