"""Sources of ticks."""
