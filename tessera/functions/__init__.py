"""Part of the content pipeline."""
