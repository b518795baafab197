"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the registered queries and their SQL are in ``queries.py``.
"""
