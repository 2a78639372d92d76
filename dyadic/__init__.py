"""dyadic: response-prediction analytics for dyad tables on Spark.

Tables of (entity, entity, term, features..., response) rows are prepared,
encoded, modelled and explained with DataFrame jobs.  Sub-packages:

* ``sources``   scans, sinks and parameter tables
* ``functions`` column expressions (clip, binning, counter RNG, array algebra)
* ``operators`` preparation, aggregates, windows, scoring, training, importance
* ``plans``     registered queries over the shared test tables and their SQL
* ``streaming`` term-by-term incremental append
"""

from dyadic.guide import FeatureGuide

__all__ = ["FeatureGuide"]
