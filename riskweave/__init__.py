"""Model-reliability analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions and classes of this package travel to the workers with the plan, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
