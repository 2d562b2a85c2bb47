"""Spark-native analytics for federated social content and diffusion graphs.

Functions of this package that run inside tasks are pickled whole, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
