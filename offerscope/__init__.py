"""Offer-campaign analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so that
# executors need numpy, pandas and pyarrow but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
