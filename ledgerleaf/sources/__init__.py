"""Readers of logs, pipe text, footers, workbooks and word files, and the sinks."""
