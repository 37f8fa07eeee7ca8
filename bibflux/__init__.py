"""bibflux: a Spark-native engine for collections of scholarly records."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code, so that executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
