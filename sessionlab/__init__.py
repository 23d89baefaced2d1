"""sessionlab: multi-sensor session analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# grouped pandas functions travel to executors by value, so workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
