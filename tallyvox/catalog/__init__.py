"""Registered queries with their plain-SQL counterparts."""
