"""Open-relation analytics on Spark: triples, clusters, questions, scores."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Batch functions travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
