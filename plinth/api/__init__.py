"""Ways in from outside: the wire protocol server and its settings."""
