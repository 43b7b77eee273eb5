"""Structured Streaming: spike rates of an event stream."""
