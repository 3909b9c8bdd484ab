"""Document sensitivity labelling as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors
# need neither the package on their path nor a shipped archive.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
