"""Intentionally empty: every load is a complete batch snapshot, so no job here reads a stream."""
