"""Rolling statistics and stateful nodes."""
