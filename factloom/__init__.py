"""Analytics over a governed store of short facts, on PySpark DataFrames.

Operators are functions from DataFrames to DataFrames. The clock is always an
argument, never read inside an operator, so that every result can be checked.
"""
