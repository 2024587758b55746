"""tallyho: Spark-native operators for bulk text-classification campaigns.

Every operator takes and returns DataFrames (or Columns); the work runs as
Catalyst expressions, joins, aggregates and windows.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's code with every Python task (Arrow UDFs, applyInPandas,
# mapInPandas, streaming state functions) instead of pickling references to
# it: executors then need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from tallyho.session import get_spark, checkpoint_dir  # noqa: E402,F401

__version__ = "0.1.0"
