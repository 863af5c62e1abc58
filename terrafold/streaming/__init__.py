"""Streams of frames: playback, cells of each batch, memory of whole sequences."""
