"""Bindings of operators to the test tables, with the SQL that defines each result."""
