"""Posting analytics on Spark: land, parse, deduplicate, mine and report.

Functions take and return DataFrames or Columns. Nothing here reads the clock:
callers pass ``as_of`` or ``run_ts``.
"""
