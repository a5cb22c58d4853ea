"""Parameters of the caller."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    min_segment: int = 100
    max_gap: int = 50
    min_overhang: int = 200
    location_flank: int = 50
    edge_distance: int = 50
    blacklist_flank: int = 2
    aligned_fraction: float = 0.8
    min_probability: float = 0.5
    low_mapq: int = 5
    read_flank: int = 3000
    #: Positions of a tile in clustering and of a bin in interval joins.
    tile: int = 1 << 20
    bin: int = 1 << 11

    def __post_init__(self):
        for name in ("min_segment", "max_gap", "min_overhang", "tile", "bin"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


DEFAULT = Config()
