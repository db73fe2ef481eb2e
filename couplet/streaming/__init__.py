"""Intentionally empty: the covered feature set is batch only (no watermark, window or state)."""
