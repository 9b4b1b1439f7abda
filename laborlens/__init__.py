"""laborlens — labour-market microdata analytics on Spark DataFrames.

Sub-packages
------------
functions  Column -> Column scalar rules (code harmonisation, parsing, bands).
operators  DataFrame -> DataFrame operators (filters, aggregates, quantiles,
           windows, joins, sampling, quality, statistics, ML).
sources    scans and sinks (fixed-width, delimited, archives, ledgers).
plans      named report queries over the bundled test tables + SQL oracles.
streaming  file-source ingestion and windowed feed counts.
"""

import sys as _sys

# Functions that run on executors (pandas UDFs, mapInPandas bodies) are
# shipped by value, so workers never need this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from laborlens.session import get_session, checkpoint_dir  # noqa: F401,E402

__all__ = ["get_session", "checkpoint_dir"]
