"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the driver entry adds its
queries only when it can be imported.
"""
