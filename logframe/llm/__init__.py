"""Training-data operators: sharding, scoring, matching, redaction and encoding of text tables.

Nothing else in the library imports this subpackage.
"""
