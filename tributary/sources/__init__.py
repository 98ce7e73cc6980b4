"""Readers of reports, facts, scopes, settings and manifests."""
