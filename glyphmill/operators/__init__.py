"""DataFrame -> DataFrame stages of a corpus transformation."""
