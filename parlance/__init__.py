"""parlance: transcript analytics on Spark.

DataFrame in, DataFrame out.  Every job is keyed by ``transcript_id`` (or a
job name) so that any number of transcripts is processed in one plan (RM-1:
batch processing of many files is inherent, not a separate feature).

Sub-packages
------------
sources     readers for notifications, raw/enhanced transcripts, audio listings, job events
functions   column expressions (whitespace, keys, times, JSON cleaning, labels)
operators   table-level jobs (interval join, packing, recombination, entities, jobs, ...)
sinks       result table writer with idempotent partition overwrite
streaming   Structured Streaming versions of the upload / status / result flows
plans       the registered queries over the driver tables, with their DuckDB oracles
"""

__version__ = "0.1.0"
