"""Spark-native record linkage and audit-event tables: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
