"""Feature extractors, distances, clustering, evaluation and views."""
