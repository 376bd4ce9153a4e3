"""All named queries, by area."""

from facadelake.plans import q_geometry, q_learn, q_masks, q_rules, q_scoring, q_store, q_streams, q_temporal, q_windows  # noqa: F401
from facadelake.plans.registry import ORACLES, QUERIES, with_views  # noqa: F401


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in ORACLES.items()}
