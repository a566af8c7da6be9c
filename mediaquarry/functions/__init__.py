"""functions of the media-catalog engine."""
