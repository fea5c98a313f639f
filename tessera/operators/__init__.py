"""Relational operators over clips: coverage, sampling, metrics, evidence, routing, sequences, profiles."""
