"""Every query of the library proper, by name, with its SQL."""

from __future__ import annotations

from lumenframe.plans import approximate, arms, evaluation, fits, inventory, more, pixels, relational, renditions, retrieval, studies, text  # noqa: F401
from lumenframe.plans.registry import ORACLE, QUERIES

FLAGSHIP = "sel2_top_per_scene_best_fit"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
