"""Operators of the surveillance-performance engine."""
