"""Rule-driven scanning of text and source artifacts on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel whole, so a cluster needs no copy of this package on its Python path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
