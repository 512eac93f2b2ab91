"""webrake: web-corpus curation and entity-record extraction on Spark.

Pages, search hits, model answers, extracted records and link graphs are
DataFrames.  Scalar work is expressed as ``Column`` builders
(``webrake.functions``); table work as ``DataFrame -> DataFrame`` operators
(``webrake.operators``); composite jobs live in ``webrake.plans``.
"""

__version__ = "0.1.0"
