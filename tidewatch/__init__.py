"""Anomaly detection over ordered, labelled, multivariate series, as Spark jobs."""

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(__import__(__name__))
