"""Operators for preparing training text: formatting, fingerprints, filters, dedup, mixing, tokens, models.

Nothing outside this package imports it; ``queries`` registers what it offers.
"""
