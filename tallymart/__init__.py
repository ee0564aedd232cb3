"""tallymart: retail demand and customer analytics as Spark DataFrame jobs."""

from tallymart.config import Config

__all__ = ["Config"]
