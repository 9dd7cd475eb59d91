"""claimloom: sourced product evidence, category matching and template filling as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns).  Thresholds are
keyword arguments; nothing keeps state between calls.
"""
