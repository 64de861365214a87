"""Logical plans: the catalogue of queries and the SQL they must agree with."""
