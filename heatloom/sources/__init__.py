"""Readers and writers. Inputs are landed files; nothing here uses a network."""
