"""Readers, request checks and sinks."""
