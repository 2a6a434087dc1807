"""Word-vector analytics on Spark DataFrames.

Every public function takes and returns DataFrames of the word table
``(index bigint, word string, vector array<double>)`` or of tables derived from it.
"""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with them, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
