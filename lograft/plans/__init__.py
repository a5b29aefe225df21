"""Layouts: per-record text built as one column expression."""
