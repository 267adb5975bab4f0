"""Structured Streaming: sessions, checkpoints, windows."""
