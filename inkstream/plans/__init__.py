"""Registered queries: name -> callable, and the SQL they are checked against."""
