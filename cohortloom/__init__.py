"""Cohort analytics as Spark jobs: DataFrame operators for matrices, subjects, splits, metrics and text corpora.

Functions that run inside tasks are pickled by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
