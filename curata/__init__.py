"""curata: a Spark-native engine for preparing and evaluating multi-label text corpora.

Every operator takes and returns a lazy ``pyspark.sql.DataFrame``; the query
registry that ties operators to the driver's test tables lives in
``curata.plans``.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from curata.session import get_spark, shared_dir  # noqa: F401

# Python functions sent to executors (pandas UDFs, mapInPandas) are pickled by
# value, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["get_spark", "shared_dir"]
