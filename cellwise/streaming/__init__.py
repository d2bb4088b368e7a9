"""Reports as a stream: counts by window, and cells that are scored again with every batch."""
