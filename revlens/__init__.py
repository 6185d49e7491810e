"""revlens: change-history analytics as Spark DataFrame jobs."""

from revlens.model import ChangeLog

__all__ = ["ChangeLog"]
