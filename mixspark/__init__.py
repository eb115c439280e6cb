"""Anomaly detection on mixed numeric + categorical tables, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with each task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
