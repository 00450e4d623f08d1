"""Timed-text analytics on Spark: segments, boxes and frames in, transcripts out."""
