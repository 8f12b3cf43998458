"""Readers, writers and the derivation of posts from stored tables."""
