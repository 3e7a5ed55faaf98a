"""vecroute: learned-index vector retrieval and table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
