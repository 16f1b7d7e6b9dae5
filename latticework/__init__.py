"""Frequent-pattern analytics over graph collections, planned by Catalyst."""
