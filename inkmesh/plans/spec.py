"""What a map query asks for: the catalogue of analyses, their defaults and their errors."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Analyses and the units that each allows.
CATALOGUE = {
    "cooccurrence": ("all_keywords", "keywords", "index_terms", "terms"),
    "coauthorship": ("authors", "orgs", "countries"),
    "citation": ("documents", "sources", "authors", "orgs", "countries"),
    "coupling": ("documents", "sources", "authors", "orgs", "countries"),
    "cocitation": ("refs", "cited_sources", "cited_authors"),
}
NORMALISATIONS = ("association", "fractionalization", "linlog", "none")


@dataclass(frozen=True)
class MapSpec:
    """Settings of one map. min_count None takes the analysis's default (see minimum)."""

    analysis: str = "cooccurrence"
    unit: str = "keywords"
    min_count: int | None = None
    min_cites: int = 0
    min_link: float = 0.0
    max_items: int = 1000
    max_authors: int = 25
    max_ref_docs: int = 2000
    fractional: bool = False
    largest: bool = True
    term_keep: float = 0.6
    year_from: int | None = None
    year_to: int | None = None
    normalisation: str = "association"

    def __post_init__(self) -> None:
        if self.analysis not in CATALOGUE:
            raise ValueError(f"unknown analysis {self.analysis!r}; one of {', '.join(CATALOGUE)}")
        if self.unit not in CATALOGUE[self.analysis]:
            raise ValueError(f"{self.analysis} has no unit {self.unit!r}; one of {', '.join(CATALOGUE[self.analysis])}")
        if self.normalisation not in NORMALISATIONS:
            raise ValueError(f"unknown normalisation {self.normalisation!r}; one of {', '.join(NORMALISATIONS)}")
        if self.max_items < 2:
            raise ValueError("a map needs two items or more")

    @property
    def minimum(self) -> int:
        """Least measure of an item: 5; of terms 10; of cited and of coupled or citing documents 20."""
        if self.min_count is not None:
            return self.min_count
        if self.analysis == "cocitation" or (self.analysis in ("citation", "coupling") and self.unit == "documents"):
            return 20
        return 10 if self.unit == "terms" else 5

    def but(self, **changes: object) -> MapSpec:
        return replace(self, **changes)


def catalogue() -> list[tuple[str, str]]:
    """The twenty valid pairs of analysis and unit."""
    return [(a, u) for a, units in CATALOGUE.items() for u in units]
