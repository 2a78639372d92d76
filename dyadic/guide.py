"""Feature guide: which columns are the target, the entities, the
categorical and the real-valued features.  The first entity is the
*profiled* one (it owns the membership vectors of IPR / MLR)."""

from __future__ import annotations

from dataclasses import dataclass, field


class GuideError(ValueError):
    """A guide that cannot be used, or a table that lacks a guided column."""


@dataclass(frozen=True)
class FeatureGuide:
    target: str
    ents: tuple[str, ...]
    cats: tuple[str, ...] = field(default_factory=tuple)
    reals: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "ents", tuple(self.ents))
        object.__setattr__(self, "cats", tuple(self.cats))
        object.__setattr__(self, "reals", tuple(self.reals))
        if not self.target:
            raise GuideError("guide needs exactly one target")
        if len(self.ents) < 1:
            raise GuideError("guide needs at least one entity")
        names = [self.target, *self.ents, *self.cats, *self.reals]
        if len(set(names)) != len(names):
            raise GuideError(f"guide names a column twice: {names}")

    @property
    def profiled(self) -> str:
        return self.ents[0]

    @property
    def fields(self) -> tuple[str, ...]:
        """One-hot blocks in encoding order: entities, then categoricals."""
        return self.ents + self.cats

    @property
    def columns(self) -> list[str]:
        return [self.target, *self.ents, *self.cats, *self.reals]

    def roles(self) -> dict[str, str]:
        r = {self.target: "target"}
        r.update({c: "entity" for c in self.ents})
        r.update({c: "categorical" for c in self.cats})
        r.update({c: "real" for c in self.reals})
        return r

    def require_features(self) -> None:
        """FM-style models need at least one categorical or real feature."""
        if not (self.cats or self.reals):
            raise GuideError("guide needs at least one categorical or real feature")
