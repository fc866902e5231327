"""Table cleaning on Spark: profile, inspect, clean, keep versions, export."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors as code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
