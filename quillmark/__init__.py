"""Evaluation analytics on Spark.

What runs inside Spark's Python workers is shipped by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
