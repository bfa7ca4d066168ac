"""Analytical operators over the long table of predictions."""
