"""Training-data operators: ten dealt operators and their registered queries.

Nothing else in the library imports this subpackage.  Each operator is a
``DataFrame -> DataFrame`` function with its own general interface; the
queries of :mod:`webrake.llm.queries` derive the contract columns from it.
"""
