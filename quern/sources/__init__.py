"""Where records live: the commit log, blobs and the JSON codec."""
