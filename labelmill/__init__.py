"""PySpark-native curation and analysis of instruction-labelled text datasets and reward traces."""

import sys

from pyspark import cloudpickle

#: Data sources, state processors and functions of this package travel to Python workers by value, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
