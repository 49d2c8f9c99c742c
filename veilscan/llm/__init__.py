"""Operators for preparing training data: one module per operator.

Nothing else in the package imports this one.
"""
