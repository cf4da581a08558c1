"""Time-series anomaly analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to tasks travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
