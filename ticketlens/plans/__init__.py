"""Compositions of operators: the ticket stages and the test binding."""
