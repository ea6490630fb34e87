"""lexiprop: synonym-set expansion on Spark (DataFrame API)."""

import sys as _sys

# Functions of this package that run inside Arrow/pandas tasks are shipped with
# the task (pickled by value), so executors need no installed copy of it.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
