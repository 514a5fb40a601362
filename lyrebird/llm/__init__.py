"""Training-data operators. Nothing outside this subpackage imports it."""

import lyrebird
from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(lyrebird)
