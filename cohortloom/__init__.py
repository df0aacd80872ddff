"""Cohort-matrix analytics as Spark jobs: one long table (modality, sample, feature, value) in, results out."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
