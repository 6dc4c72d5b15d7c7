"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its functions travel to
Python workers by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
