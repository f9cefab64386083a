"""Streaming of the surveillance-performance engine."""
