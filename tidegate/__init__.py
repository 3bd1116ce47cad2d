"""Tidegate: ETL and data-quality operators as composable Spark DataFrame transformations."""

from tidegate.errors import DataQualityError, DeliveryError

__all__ = ["DataQualityError", "DeliveryError"]
