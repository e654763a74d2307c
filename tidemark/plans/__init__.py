"""Runs, and what can be said about them: rendering, profiles, plan guards."""
