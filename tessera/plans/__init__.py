"""Layouts and filters that let scans skip data."""
