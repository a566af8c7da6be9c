"""plans of the media-catalog engine."""
