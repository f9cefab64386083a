"""Plans of the surveillance-performance engine."""
