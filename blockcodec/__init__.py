"""blockcodec: compressed-byte analytics on Spark DataFrames.

The package is shipped to Python workers by value, so that a session whose
executors cannot import it (no PYTHONPATH, no --py-files) still runs its UDFs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
