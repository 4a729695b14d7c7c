"""Plans over the trigram index."""
