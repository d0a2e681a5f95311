"""Writers of chunk datasets."""
