"""Whole analyses composed from the operators, and the queries registered for checking."""
