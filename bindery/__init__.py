"""bindery: document bundles, job analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the code of their functions from the driver, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
