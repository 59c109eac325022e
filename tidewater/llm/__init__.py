"""Operators that prepare training data: each module holds one operator; queries.py holds its queries and SQL."""
