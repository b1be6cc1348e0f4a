"""Structured Streaming forms of the feeds: events, logs and replays."""
