"""Functions that run on executors are shipped by value, so workers need no copy of this repository."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
