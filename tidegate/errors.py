"""Errors raised by gates and sinks."""


class DataQualityError(ValueError):
    """A gate found violations."""


class DeliveryError(RuntimeError):
    """One or more payloads could not be delivered."""
