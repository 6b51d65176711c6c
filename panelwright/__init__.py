"""Spark-native analytics for panels of daily time series.

Tables are long panels ``(symbol, date, ...)``; operators take and return DataFrames and leave the
physical plan to Catalyst.  See README.md for the layout and the scale notes.
"""

import sys

from pyspark import cloudpickle

# Grouped kernels travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
