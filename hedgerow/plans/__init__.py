"""Whole scans and the reports over their findings."""
