"""Readers, rule tables and sinks."""
