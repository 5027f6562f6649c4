"""Registered jobs."""
