"""Training-data operators (numbered 1 to 13 in README.md); nothing outside this folder imports them.

Functions of this package travel to the executors by value, so a cluster needs
no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
