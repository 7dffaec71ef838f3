"""Adapters from the test tables, end-to-end plans and registered queries."""
