"""Warehouse-load operators for Spark: plain ``DataFrame -> DataFrame`` functions.

Sub-packages
------------
functions  ``Column`` helpers with legacy-warehouse semantics
sources    scans: tables, SQL, CSV, JDBC, sampling, inventory
operators  mapping, schema enforcement, masking, dedupe, incremental, keys,
           lookup, merge, slowly changing dimensions, quality, profiling ...
sinks      versioned commits, partitioned and evolving writes, JDBC, layout
plans      composed loads: facts, bronze/silver/gold, load dispatch, query catalogue
streaming  the same loads inside ``foreachBatch``
"""

__version__ = "0.1.0"
