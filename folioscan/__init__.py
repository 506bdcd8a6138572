"""Document-quality analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with what they use of this package, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
