"""Analysis parameters."""

from dataclasses import dataclass

from pairwise.constants import PRESETS


@dataclass(frozen=True)
class ConsensusParams:
    """Thresholds shared by the consensus strategies."""

    min_consensus: int = 2
    probability: float = 0.6
    confidence: float = 0.7

    def __post_init__(self):
        if self.min_consensus < 1:
            raise ValueError("min_consensus must be 1 or more")
        for name in ("probability", "confidence"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} threshold must lie in [0, 1]")

    @classmethod
    def preset(cls, name: str, min_consensus: int = 2) -> "ConsensusParams":
        probability, confidence = PRESETS[name]
        return cls(min_consensus, probability, confidence)


def sweep_thresholds() -> list[float]:
    """0.50, 0.55 … 0.95."""
    return [round(0.5 + 0.05 * i, 2) for i in range(10)]
