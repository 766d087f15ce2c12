"""Training-data operators. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
