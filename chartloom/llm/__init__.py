"""Operators for training-data pipelines, one module each.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator.
"""
