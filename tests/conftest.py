from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from stepwise.model import EVENT_SCHEMA
from stepwise.session import local_session

BASE = datetime(2024, 1, 1, 10)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Event table from (user, event, minutes after BASE or datetime or None[, props])."""

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            user, name, at, *rest = row
            when = at if at is None or isinstance(at, datetime) else BASE + timedelta(minutes=at)
            props = rest[0] if rest else None
            user_props = rest[1] if len(rest) > 1 else None
            out.append((user, name, when, props, user_props, i))
        return spark.createDataFrame(out, EVENT_SCHEMA)

    return build


@pytest.fixture(scope="session")
def users():
    """Users per step of a funnel table, or per segment when segmented."""

    def collect(table, segmented=False):
        rows = table.orderBy("segment", "step_idx").collect()
        if not segmented:
            return [r["users"] for r in rows]
        found: dict[str, list[int]] = {}
        for r in rows:
            found.setdefault(r["segment"], []).append(r["users"])
        return found

    return collect
