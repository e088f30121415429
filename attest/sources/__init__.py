"""Readers and writers: traces, logs, robot descriptions, meshes, scenes."""
