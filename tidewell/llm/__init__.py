"""Operators for preparing training text at scale.

Nothing outside this folder imports it; the query registry adds its queries
only when the folder is present.
"""
