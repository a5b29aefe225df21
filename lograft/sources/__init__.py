"""Reading and writing raw log lines."""
