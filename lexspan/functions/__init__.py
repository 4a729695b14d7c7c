"""Expressions that search builds on: regex dialect, globs, trigrams, fuzzy scores."""
