"""Relational operators of the serving-operations jobs (DataFrame in, DataFrame out)."""
