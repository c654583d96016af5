"""Operators for text and matching problems of training-data pipelines.

Nothing outside this subpackage imports it.
"""
