"""The driver queries and their SQL."""
