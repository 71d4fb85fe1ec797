"""Parameters that change results, with the reference defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ImportanceWeights:
    change_ratio: float = 0.3
    magnitude: float = 0.3
    land_impact: float = 0.2
    recency: float = 0.2


@dataclass(frozen=True)
class Params:
    zoom: int = 16
    similarity_threshold: float = 0.92
    min_largest_run: int = 2
    min_change_ratio: float = 0.0
    confidence_floor: float = 0.5
    cell_size: int = 16
    diff_threshold: int = 28
    min_area: int = 4
    weights: ImportanceWeights = field(default_factory=ImportanceWeights)
    hotspot_eps_km: float = 15.0
    hotspot_min_samples: int = 5
    drop_ai_false: bool = False
    k_default: int = 6
    max_features: int = 4000
    hard_limit: int = 20000
    probe_steps: int = 100
    probe_rate: float = 4.0

    def with_(self, **kw) -> Params:
        return replace(self, **kw)


DEFAULT = Params()

# Parameters used by the driver-table fixtures (FIXTURES.md): the test vectors are random with
# mean 0, so the noise threshold is 0.0 there; the default 0.92 is exercised by the unit tests.
FIXTURE = Params(similarity_threshold=0.0)
