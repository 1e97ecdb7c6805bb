"""Readers, writers, manifests and profiles."""
