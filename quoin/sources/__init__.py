"""Scans of PDF and IDML files into fact tables, profiles, and sinks."""
