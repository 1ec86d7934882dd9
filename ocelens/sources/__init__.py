"""Readers and writers: span dumps, event-log files and tables, sidecars."""
