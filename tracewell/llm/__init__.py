"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``queries`` and ``oracles`` hold what the
repository's entry file registers.
"""
