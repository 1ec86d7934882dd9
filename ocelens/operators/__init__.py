"""DataFrame to DataFrame operators over object-centric event logs."""
