"""Plans of the corpus engine."""
