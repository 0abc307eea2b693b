"""Column expressions: text, markup, URLs, outcomes and logs."""
