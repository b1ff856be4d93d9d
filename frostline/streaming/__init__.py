"""Continuous versions of the boards: punch and proof feeds with Structured Streaming.

Event times are local wall clock read as TIMESTAMP; run streams with the session time zone set to UTC.
"""
