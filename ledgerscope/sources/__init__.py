"""Readers, payload jobs and sinks."""
