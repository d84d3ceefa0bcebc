"""lexspan: chunk, embed, index, retrieve and evaluate long documents as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions handed to Python workers travel by value, so executors need no copy
# of this package on their path.
register_pickle_by_value(sys.modules[__name__])
