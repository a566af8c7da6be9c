"""streaming of the media-catalog engine."""
