"""operators of the media-catalog engine."""
