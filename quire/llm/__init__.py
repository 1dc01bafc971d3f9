"""Operators of a training-data pipeline: filtering, de-duplication, scoring and mixing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
