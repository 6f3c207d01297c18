"""Binds the test tables to operators, and states the same results in SQL."""
