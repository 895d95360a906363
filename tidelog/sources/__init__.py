"""Readers and writers: issue CSV, chat transcripts, JSON exports, workspaces, demo data."""
