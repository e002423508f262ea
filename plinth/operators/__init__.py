"""DataFrame operators beyond plain SQL."""
