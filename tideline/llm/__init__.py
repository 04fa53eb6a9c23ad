"""Operators for preparing training text: ten numbered operators and their registered queries.

Nothing else in the library imports this subpackage.
"""
