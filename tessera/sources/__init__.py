"""Readers: manifests, strict tables, audio files, findings."""
