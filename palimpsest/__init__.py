"""Palimpsest: event-sourced session memory and its evaluation as Spark operators."""
