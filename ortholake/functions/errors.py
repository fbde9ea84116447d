"""The error that every operator raises for input it can't compute from."""


class InputError(ValueError):
    """Input that breaks an operator's contract; the message names the column or parameter."""
