"""bomloom: a Spark-native analytics engine for software bills of materials."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow stages travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
