"""Readers and writers of releases, snapshots, graphs and runs."""
