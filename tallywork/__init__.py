"""Practice billing and attendance analytics as PySpark DataFrame operators."""

from tallywork.practice import Practice

__all__ = ["Practice"]
