"""Whole queries: the binding to the test tables, the query catalog and its SQL."""
