"""Registered queries over the driver's tables, with SQL twins."""


def load() -> tuple[dict, dict]:
    """All queries and their SQL, by name."""
    from loomwork.plans import base, frame_queries, interval_queries, metric_queries, pipeline_queries, text_queries  # noqa: F401

    return base.QUERIES, base.ORACLE_SQL
