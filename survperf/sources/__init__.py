"""Sources of the surveillance-performance engine."""
