"""Streams: an extension, the batch operators of this library have no counterpart there."""
