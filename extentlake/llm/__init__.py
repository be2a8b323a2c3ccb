"""Operators for preparing training text: each module holds one, its query and its SQL."""
