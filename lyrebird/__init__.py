"""Timed-text analytics and retrieval engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions sent to executors carry the package's code with them: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
