"""Change feeds as streams and the views they maintain."""
