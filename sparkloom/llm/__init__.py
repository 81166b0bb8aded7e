"""Training-data operators: extraction, scanning, scoring, near-dedup, mixing, quality rules and tokenization.

Nothing else in the library imports this subpackage.
"""
