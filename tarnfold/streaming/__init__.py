"""Micro-batch forms of the incremental merge."""
