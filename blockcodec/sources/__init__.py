"""The snappy_frames data source."""
