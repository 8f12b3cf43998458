"""postweave: topic graphs of short posts, built from Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package are sent to the executors by value, so the
# package need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
