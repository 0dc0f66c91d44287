"""Parameters of the scoring rules; every operator takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds by language.
LANGUAGES = ("CPP", "PYTHON")
TOKEN_FLOOR = {"CPP": 70, "PYTHON": 55}
SHORT_CEILING = {"CPP": 110, "PYTHON": 100}
FLAG_THRESHOLD = {"CPP": 0.9819274, "PYTHON": 0.9700251}
LOW_ANCHOR = {"CPP": 0.9212929606437682, "PYTHON": 0.8960224390029906}

# Thresholds shared by the languages.
LOW_DIVERSITY = 0.030
WORDING_DIVERSITY = 0.050
CARD_DIVERSITY = 0.060
COMMENTED_DISCOUNT = 0.12
HIGH_SCORE = 0.98
DESCRIPTIVE_FLOOR = 0.42
NAMING_NOTE_FLOOR = 0.45
FPR_TARGETS = (0.01, 0.05)
FOLDS = 5
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
CONSENSUS_TOKENS = 60
CONSENSUS_CONFIDENCE = 85.0
CONSENSUS_VOTES = 2


@dataclass(frozen=True)
class Anchors:
    """Display anchors by language: (low, midpoint)."""

    by_language: dict[str, tuple[float, float]] = field(default_factory=lambda: {k: (LOW_ANCHOR[k], FLAG_THRESHOLD[k]) for k in LANGUAGES})
