"""All registered queries of the engine with their oracle SQL."""

from __future__ import annotations

from lanternwatch.plans import activity, content, policy  # noqa: F401
from lanternwatch.plans.common import ORACLE_SQL, QUERIES  # noqa: F401
