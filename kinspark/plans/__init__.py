"""The operators chained into the whole study, and the queries built on it."""
