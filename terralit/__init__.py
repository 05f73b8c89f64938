"""Terralit: geographic-literature analytics as Spark DataFrame plans."""
