"""DataFrame operators over captured documents."""
