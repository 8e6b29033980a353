"""Streaming extensions: running metrics and resumable scoring."""
