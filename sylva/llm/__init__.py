"""Operators for preparing training text: mixing, tokenizing, deduplicating, filtering, fingerprinting.

Nothing outside this folder imports it. `queries.py` lists what the driver runs.
"""
