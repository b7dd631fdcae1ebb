"""Images as they come: the configured pipeline over a stream of files."""
