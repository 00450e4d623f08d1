"""DataFrame operators on segments, boxes, frames and audio."""
