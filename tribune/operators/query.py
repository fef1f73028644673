"""Keyword queries: commas part alternatives, spaces part words that must all occur."""

from __future__ import annotations

from .analyzer import Analyzer

#: Words that queries leave out (the index keeps them), fixed values.
STOPWORDS = {
    "ja", "ning", "ega", "ehk", "nii", "või", "et", "on", "oli", "olema",
    "see", "seda", "selle", "siis", "ka", "kui",
    "me", "ma", "sa", "ta", "nad",
    "meie", "teie", "mina", "sina", "nemad",
}


def parse_query(query: str, analyzer: Analyzer, dedupe_terms: bool = False) -> list[list[str]]:
    """Groups of lemmas, one for each alternative that has any left. A lemma that is repeated in a
    group makes it unsatisfiable, as a count of distinct lemmas never reaches the group's length, unless dedupe_terms is set."""
    each = (filter(lambda w: w not in STOPWORDS, own) for own in analyzer.tokens_of(*query.split(",")))
    groups = [list(dict.fromkeys(own)) if dedupe_terms else list(own) for own in each]
    return [g for g in groups if g]


def build_query(groups: list[list[str]]) -> str:
    """The query of groups of words; empty words and groups drop out."""
    parts = (" ".join(w.strip() for w in g if w.strip()) for g in groups)
    return ", ".join(p for p in parts if p)
