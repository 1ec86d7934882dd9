"""Object-centric event analytics on PySpark: DataFrame operators over event logs."""

from ocelens.model import EventLog

__all__ = ["EventLog"]
