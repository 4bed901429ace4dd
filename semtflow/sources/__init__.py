"""Readers, writers, dimensions and derived inputs."""
