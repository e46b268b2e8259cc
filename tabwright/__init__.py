"""Automated machine learning on tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
