"""Whole queries composed of operators, and the registry of named queries."""
