"""Set-at-a-time processing of job postings on Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
