"""Structured Streaming: arriving pages, task events, heartbeats and latest states."""
