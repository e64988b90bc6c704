"""Errors, with the exit codes that a command line would end with."""


class StrandError(Exception):
    exit_code = 3


class InvalidInput(StrandError):
    """Data that a format doesn't allow."""

    exit_code = 1


class ConfigError(StrandError, ValueError):
    """Parameters that don't fit."""

    exit_code = 2


class StorageError(StrandError):
    exit_code = 4
