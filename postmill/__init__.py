"""postmill: posting analytics and training-data operators, declared on PySpark DataFrames.

Functions that run on executors travel by value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
