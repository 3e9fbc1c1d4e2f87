"""Streams: bookmarks as keyed state."""
