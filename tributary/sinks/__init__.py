"""Merged reports, renderings and verdicts as written output."""
