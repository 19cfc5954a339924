"""Operators on growing logs."""
