"""Tables from files and back: Parquet and Arrow IPC."""
