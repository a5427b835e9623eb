"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. Its Python functions travel to the executors
by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
