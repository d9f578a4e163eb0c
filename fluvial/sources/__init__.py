"""Readers, writers and checkpoints."""
