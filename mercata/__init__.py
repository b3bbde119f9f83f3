"""Analytics on Spark: retail lakehouse queries and operators for training data.

Functions of the package travel to Python workers by value, so executors need the libraries it uses but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
