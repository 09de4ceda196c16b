"""scanloom: maps of images and other array-valued scan data, processed as plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Vectorised kernels travel inside the task, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
