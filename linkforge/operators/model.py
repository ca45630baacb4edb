"""Weights, thresholds, and the fold that learns from decisions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from linkforge.schemas import FEATURES

#: The initial weights, thresholds, and limits of learning.
WEIGHTS = {"pan": 0.35, "name": 0.30, "address": 0.15, "pinCode": 0.10, "sector": 0.05, "phone": 0.05}
AUTO_LINK, REVIEW, IDENTIFIER_FLOOR = 0.85, 0.50, 0.92
RATE, LEAST, MOST = 0.02, 0.01, 0.60


@dataclass(frozen=True)
class Model:
    """One version of the scoring model; a batch reads one version from start to end."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    auto_link: float = AUTO_LINK
    review: float = REVIEW
    feedback: int = 0

    def learned(self, features: Mapping[str, float], match: bool) -> Model:
        """After one decision. Weights are looked up by their own names, so the identifier's moves by scaling alone."""
        w = dict(self.weights)
        for k in w:
            if k in features:
                agreement = features[k] if match else 1 - features[k]
                w[k] = min(MOST, max(LEAST, w[k] + RATE * (agreement - 0.5)))
        total = sum(w.values())
        return replace(self, weights={k: v / total for k, v in w.items()}, feedback=self.feedback + 1)

    def folded(self, decisions: Iterable[tuple[Mapping[str, float], bool]]) -> Model:
        """Decisions in their order: the fold doesn't commute."""
        out = self
        for features, match in decisions:
            out = out.learned(features, match)
        return out

    def weight_of(self, feature: str) -> float:
        return self.weights[dict(FEATURES)[feature]]

    def properties(self) -> str:
        lines = [f"weight.{k}={v!r}" for k, v in self.weights.items()]
        return "\n".join([*lines, f"autoLinkThreshold={self.auto_link!r}", f"reviewThreshold={self.review!r}", f"feedbackCount={self.feedback}"]) + "\n"

    @classmethod
    def parse(cls, text: str) -> Model:
        """From properties; keys that are missing keep their defaults."""
        given = dict(x.strip().split("=", 1) for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
        given = {k.strip(): v.strip() for k, v in given.items()}
        return cls({k: float(given.get(f"weight.{k}", v)) for k, v in WEIGHTS.items()}, float(given.get("autoLinkThreshold", AUTO_LINK)), float(given.get("reviewThreshold", REVIEW)), int(given.get("feedbackCount", 0)))

    def to_json(self) -> str:
        import json

        return json.dumps({"weights": {k: round(v, 4) for k, v in self.weights.items()}, "autoLinkThreshold": self.auto_link, "reviewThreshold": self.review, "feedbackCount": self.feedback})
