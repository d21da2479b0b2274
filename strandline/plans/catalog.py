"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from strandline.plans import body, colour, frames, hands, motion, refine, session, shapes, sync  # noqa: F401  (each registers its queries)
from strandline.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "j3_sync_frames"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
