"""quarry: a PySpark-native data-mining library.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column builders),
``operators`` (relational operators), ``plans`` (multi-step plans and lineage),
``streaming`` (incremental forms), ``queries`` (registered queries with their SQL)
and ``llm`` (operators for training-data work; nothing outside it imports it).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value: they need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
