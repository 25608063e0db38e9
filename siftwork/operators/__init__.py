"""Operators over artifacts, rules and findings."""
