"""fieldledger: dataset operators for preparing and scoring structured document extraction on Spark."""

import sys

from pyspark import cloudpickle

# Ship the small per-batch Python helpers inside the tasks, so that executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
