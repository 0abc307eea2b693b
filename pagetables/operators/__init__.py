"""DataFrame operators: pages to typed records."""
