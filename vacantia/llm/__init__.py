"""Operators for training data: ten of them, each in a module of its own, and the queries that apply them.

Nothing else in the package imports this folder.
"""
