"""Named queries assembled from the operators."""
