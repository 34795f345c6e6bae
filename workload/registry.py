"""All registered queries: name to (Spark query, SQL oracle or None)."""

from __future__ import annotations

from workload import catalog, funnels, mining, paths, timing

QUERIES: dict[str, tuple] = {
    **funnels.QUERIES,
    **timing.QUERIES,
    **paths.QUERIES,
    **mining.QUERIES,
    **catalog.QUERIES,
}
