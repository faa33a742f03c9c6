"""The one error that programs raise."""


class ProgramError(Exception):
    """A program can't be read, is not well formed, or failed while it ran."""
