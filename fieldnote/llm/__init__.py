"""Operators of a training-data pipeline: similarity joins, formatting, mixing, extraction, scoring, packing, search.

Nothing outside this folder imports it.
"""
