"""Options of the highlight engine: densities, focus modes and the limits that follow from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Density:
    """Limits for selections (quick) and whole documents."""

    quick_min_chars: int
    quick_max_chars: int
    quick_max_words: int
    quick_max_highlights: int
    min_chars: int
    max_chars: int
    max_words: int
    shortlist_size: int
    shortlist_per_page: int
    max_per_page: int
    budget_per_page: int
    least_budget: int
    most_budget: int

    def budget(self, pages: int) -> int:
        return min(self.most_budget, max(self.least_budget, math.ceil(self.budget_per_page * max(1, pages))))

    def budget_column(self, pages: Column) -> Column:
        return F.least(F.lit(self.most_budget), F.greatest(F.lit(self.least_budget), self.budget_per_page * F.greatest(F.lit(1), pages))).cast("int")


# Fixed values.
DENSITIES = {
    "sparse": Density(16, 140, 24, 2, 20, 220, 36, 60, 6, 5, 3, 10, 50),
    "balanced": Density(16, 160, 28, 3, 18, 240, 40, 100, 12, 10, 6, 20, 100),
    "dense": Density(14, 180, 32, 5, 16, 260, 44, 150, 18, 15, 10, 30, 150),
}
SECTIONS = ("abstract", "introduction", "related-work", "methods", "results", "discussion", "conclusion", "references", "other")
WEIGHTS = {
    "balanced": (4, 3, 1, 2, 5, 4, 3, -8, 2),
    "results-first": (3, 2, 1, 1, 6, 5, 3, -8, 2),
    "methods-first": (4, 3, 1, 5, 3, 2, 2, -8, 2),
    "caveats-first": (3, 3, 1, 1, 3, 6, 5, -8, 2),
}
SELECTION_THRESHOLD, DOCUMENT_THRESHOLD = 0.22, 0.24
LEAST_HEURISTIC = 2


def density(name: str | None) -> Density:
    """An unknown name means balanced."""
    return DENSITIES.get(name or "", DENSITIES["balanced"])


def section_weights(focus: str | None) -> dict[str, int]:
    return dict(zip(SECTIONS, WEIGHTS.get(focus or "", WEIGHTS["balanced"]), strict=True))


def lexical_method(name: str | None) -> str:
    return "tfidf" if name == "tfidf" else "bm25"
