"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries if it is there.
"""
