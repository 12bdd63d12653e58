"""Operators for the preparation of training text.

Nothing outside this package imports it. Each module holds one operator with its general
interface; ``queries`` applies them to the driver tables.
"""
