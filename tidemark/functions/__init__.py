"""Expressions whose semantics differ from Spark's defaults."""
