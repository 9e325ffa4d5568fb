"""Registered queries, each with the SQL that a test engine can compare it to."""
