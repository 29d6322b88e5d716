"""Operators of a training-data pipeline.

Self-contained: nothing else in the library imports this subpackage, and it
imports nothing from the rest of the library.
"""
