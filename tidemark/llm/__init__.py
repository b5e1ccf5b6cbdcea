"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames.  Functions that run on executors
are shipped by value, so a cluster needs the public Python packages but not
this repository on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
