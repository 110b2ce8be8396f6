"""Registered queries and the SQL that tells the same."""
