"""Operators of a training-data pipeline (quality, language, near copies, ...).

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` binds the operators to
the driver tables and ``oracles`` holds the DuckDB texts where SQL can say it.
"""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path: its functions
# travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
