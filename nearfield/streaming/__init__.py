"""Search over slices that come and go."""
