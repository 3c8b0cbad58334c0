"""seqloom: sequence analytics on Spark DataFrames.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package next to its Python workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
