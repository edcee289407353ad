"""Parameters of the layout analysis; values become literals of the plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

ENV_PREFIX = "PAGEGRAIN_"


@dataclass(frozen=True)
class LayoutParams:
    y_tolerance: float = 3.0
    x_tolerance: float = 3.0
    large_gap_multiplier: float = 1.8
    small_gap_multiplier: float = 1.3
    round_to_nearest_pt: float = 0.5
    line_spacing_tolerance: float = 0.2
    para_spacing_multiplier: float = 1.1
    section_spacing_multiplier: float = 2.0
    gap_rounding: float = 0.5
    points_per_inch: float = 72.0
    default_page_height: float = 792.0
    header_zone_inches: float = 1.25
    footer_zone_inches: float = 1.0
    space_width_ratio: float = 0.3
    default_font_size: float = 10.0

    @property
    def header_zone(self) -> float:
        return self.header_zone_inches * self.points_per_inch

    @property
    def footer_zone(self) -> float:
        return self.footer_zone_inches * self.points_per_inch

    def with_profile(self, name: str) -> LayoutParams:
        if name not in PROFILES:
            raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
        return replace(self, **PROFILES[name])

    @classmethod
    def from_env(cls) -> LayoutParams:
        """Defaults, overridden by PAGEGRAIN_<FIELD> where it is set."""
        found = {f.name: os.environ.get(ENV_PREFIX + f.name.upper()) for f in fields(cls)}
        return cls(**{k: float(v) for k, v in found.items() if v is not None})


# The document profiles.
PROFILES = {
    "technical": {"y_tolerance": 3.0, "x_tolerance": 2.5, "large_gap_multiplier": 1.8, "small_gap_multiplier": 1.3, "header_zone_inches": 1.25, "footer_zone_inches": 1.0},
    "academic": {"y_tolerance": 2.5, "x_tolerance": 3.0, "large_gap_multiplier": 1.6, "small_gap_multiplier": 1.2, "header_zone_inches": 1.0, "footer_zone_inches": 0.75},
    "manual": {"y_tolerance": 4.0, "x_tolerance": 3.5, "large_gap_multiplier": 2.0, "small_gap_multiplier": 1.4, "header_zone_inches": 1.5, "footer_zone_inches": 1.25},
    "dense": {"y_tolerance": 2.0, "x_tolerance": 1.5, "large_gap_multiplier": 1.5, "small_gap_multiplier": 1.2, "line_spacing_tolerance": 0.15, "para_spacing_multiplier": 1.05},
}

DEFAULTS = LayoutParams()
