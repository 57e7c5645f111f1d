"""Registered queries: callables of (session, data folder) and the SQL they are checked against."""
