"""Training-data operators: deduplication, scoring, packing, formatting and tokenisation as Spark jobs.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
