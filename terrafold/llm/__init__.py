"""Operators for large training corpora; each module holds one operator and says what it does with odd input."""
