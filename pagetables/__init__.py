"""Tables from web pages, and the history of making them, on Spark."""
