"""Embedding retrieval as PySpark DataFrame operators.

Vectors, sparse codes, inverted indexes, rankings and metrics are ordinary
tables; every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Helpers used inside Arrow functions travel with the task, so executors need
# only numpy and pyarrow, not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
