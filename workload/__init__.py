"""The registered queries: each runs an operator over the given tables, and most
have the SQL that must give the same rows."""
