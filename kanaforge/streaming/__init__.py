"""Streams: folds in order of event time, windows, caches; each has a twin over a table."""
