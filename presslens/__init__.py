"""presslens: DataFrame operators for news-corpus analytics on Apache Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``-> Column``
for the scalar helpers in :mod:`presslens.functions`).  Nothing here plans or
schedules work itself: the operators declare DataFrame / SQL plans and leave
physical choices to Catalyst and adaptive query execution.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions and classes of this package that run inside Python workers (Pandas UDFs, model
# callables) are pickled by value, so executors need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass
