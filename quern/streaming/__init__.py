"""Questions that arrive as a stream."""
