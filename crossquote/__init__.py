"""Cross-platform quote analytics on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); Spark plans, partitions and shuffles the work.
"""
