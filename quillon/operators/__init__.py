"""Clauses, select, set operations, subqueries and mutations."""
