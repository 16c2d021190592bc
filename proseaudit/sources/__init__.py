"""Explicit schemas, readers and sinks."""
