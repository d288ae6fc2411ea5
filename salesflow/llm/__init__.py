"""Operators for preparing language-model training corpora (see README, "Corpus operators")."""
