"""sources of the media-catalog engine."""
