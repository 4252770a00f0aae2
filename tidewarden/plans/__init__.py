"""Whole queries: adaptors of the test tables, dashboards, and the catalogue with its SQL."""
