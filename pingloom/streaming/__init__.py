"""Structured Streaming: live positions, per-vehicle state, smoothing."""
