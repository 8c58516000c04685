"""Streams of task logs."""
