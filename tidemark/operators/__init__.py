"""Statements that change tables, and ready-made views."""
