"""Training-data operators: deduplication, filtering, packing and archives as Spark jobs.

Nothing outside this package imports it; remove the folder and the rest still works.
"""
