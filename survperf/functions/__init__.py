"""Functions of the surveillance-performance engine."""
