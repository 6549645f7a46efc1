"""DataFrame operators of the conversion pipeline."""
