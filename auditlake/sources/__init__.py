"""Readers, and views that shape other tables like this library's inputs."""
