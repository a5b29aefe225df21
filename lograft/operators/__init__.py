"""Operators on tables of log lines."""
