"""Profiling, flattening and loading of document collections."""
