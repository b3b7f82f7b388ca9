"""A relational analytics engine built directly on PySpark DataFrames."""
