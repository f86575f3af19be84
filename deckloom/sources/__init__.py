"""Readers and writers for packages, slide graphs, images and reports."""
