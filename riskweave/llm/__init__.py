"""Operators of a training-data pipeline; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# functions of this folder travel to the workers with the plan, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
