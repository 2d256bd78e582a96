"""Medallion analytics on Spark: declarative bindings compiled to DataFrame plans."""
