"""Record linkage of free-text lines with catalogs, as DataFrame operators.

What runs in Python workers is pickled by value, so executors do not need the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
