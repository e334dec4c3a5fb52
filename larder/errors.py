"""Named errors raised by checks, loaders and writers."""


class LarderError(Exception):
    """Base class."""


class DataValidationError(LarderError):
    """A validation rule does not hold."""


class FeatureStoreError(LarderError):
    """The feature store lacks a required property."""


class LoadingError(LarderError):
    """A table or file cannot be read."""


class SavingError(LarderError):
    """A table or file cannot be written."""
