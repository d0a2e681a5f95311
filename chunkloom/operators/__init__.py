"""Document, chunk and corpus operators."""
