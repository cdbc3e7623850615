"""Table operators for fixed-grid text corpora and token / embedding tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
