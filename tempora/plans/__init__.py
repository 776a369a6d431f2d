"""Registered queries, each with the SQL that it is checked against."""
