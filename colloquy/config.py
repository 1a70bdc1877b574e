"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

from colloquy.operators import vocabulary as V


@dataclass(frozen=True)
class Settings:
    """Fixed values are the defaults that the data were tuned with; the salt has none to share and should be one's own."""

    salt: str = "colloquy"
    gap_seconds: float = 1.5
    window_size: int = 3
    window_overlap: int = 1
    attribution: str = "first_turn"
    cluster_similarity: float = V.CLUSTER_SIMILARITY
    merge_similarity: float = V.MERGE_SIMILARITY
    ground_similarity: float = V.GROUND_SIMILARITY
    seed_tables: int = 3
    labelling_sample: int = 120
    labelling_seed: int = 42
    compat: bool = True
