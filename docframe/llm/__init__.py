"""Operators for large training corpora: each module holds one operator, its query and its SQL where SQL can express it."""
