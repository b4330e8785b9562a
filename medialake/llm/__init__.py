"""Operators for preparing training text: extraction, counting, matching, scoring, packing and archiving.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
