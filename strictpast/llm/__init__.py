"""Training-data operators. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
