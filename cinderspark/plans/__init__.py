"""Registered queries: each operator applied to the test tables, next to its reference SQL."""
