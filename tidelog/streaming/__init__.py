"""Streaming transcripts: an extension, as the timeline is the one table that only grows."""
