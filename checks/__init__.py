"""Registered queries over the test tables, and the SQL each is compared with."""
