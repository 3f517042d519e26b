"""Readers and writers."""


class InputError(ValueError):
    """An input file that can't be used."""
