"""lintlake: a Spark-native engine for source-code quality analytics.

Python functions of this package that run on executors are shipped by value, so a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
