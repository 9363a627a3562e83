"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Functions that run on executors are pickled by
value, so workers need neither this folder on their path nor the driver's working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
