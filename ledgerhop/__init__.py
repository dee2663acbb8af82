"""Fund-flow analytics expressed as PySpark DataFrame jobs.

Every public function takes and returns DataFrames, works for many cases at
once (``case_id`` is an ordinary key) and leaves the physical plan to Catalyst.
"""
