"""Outputs of a run."""
