"""Operators on bundles: fields, checks, routing, metrics and review."""
