"""Training-data operators: quality, duplicates, extraction, formatting, tokens.

Nothing else in the package imports this subpackage.
"""
