"""Spark-native search for duplicate product listings."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with the tasks that use them, so executors need no
# installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
