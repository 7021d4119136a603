"""Lodestone: a PySpark-native analytics engine for training corpora and market time series."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
