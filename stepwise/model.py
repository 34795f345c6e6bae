"""Parameter objects and the canonical event schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class CountingMethod(str, Enum):
    UNIQUE_USERS = "unique_users"
    EVENT_TOTALS = "event_totals"
    UNIQUE_PAIRS = "unique_pairs"


class ReentryMode(str, Enum):
    FIRST_ONLY = "first_only"
    OPTIMIZED_REENTRY = "optimized_reentry"


class FunnelOrder(str, Enum):
    ORDERED = "ordered"
    UNORDERED = "unordered"


HOURS_PER_UNIT = {"hours": 1, "days": 24, "weeks": 168}
HOUR_US = 3_600_000_000
ALL_USERS = "All Users"
REQUIRED_COLUMNS = ("user_id", "event_name", "timestamp")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_properties", T.StringType()),
        T.StructField("user_properties", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)


@dataclass(frozen=True)
class FunnelConfig:
    """What to count and how; passed to operators, never stored by them."""

    conversion_window_hours: float = 168
    counting_method: CountingMethod = CountingMethod.UNIQUE_USERS
    reentry_mode: ReentryMode = ReentryMode.FIRST_ONLY
    funnel_order: FunnelOrder = FunnelOrder.ORDERED
    segment_by: str | None = None
    segment_values: tuple[str, ...] = ()
    # Steps whose name contains one of these skip the out-of-order check (FIRST_ONLY).
    strict_order_exempt: tuple[str, ...] = field(default=("KYC",))

    def __post_init__(self) -> None:
        set_ = object.__setattr__
        set_(self, "counting_method", CountingMethod(self.counting_method))
        set_(self, "reentry_mode", ReentryMode(self.reentry_mode))
        set_(self, "funnel_order", FunnelOrder(self.funnel_order))
        set_(self, "segment_values", tuple(self.segment_values or ()))
        if self.conversion_window_hours < 0:
            raise ValueError("conversion_window_hours must not be negative")

    @property
    def window_us(self) -> int:
        return round(self.conversion_window_hours * HOUR_US)

    @property
    def segmented(self) -> bool:
        return bool(self.segment_by and self.segment_values)

    @property
    def first_only(self) -> bool:
        return self.reentry_mode is ReentryMode.FIRST_ONLY

    @property
    def unordered(self) -> bool:
        return self.funnel_order is FunnelOrder.UNORDERED

    def to_dict(self) -> dict[str, Any]:
        plain = asdict(self)
        plain.update(
            counting_method=self.counting_method.value,
            reentry_mode=self.reentry_mode.value,
            funnel_order=self.funnel_order.value,
            segment_values=list(self.segment_values) or None,
        )
        return plain

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> FunnelConfig:
        known = set(cls.__dataclass_fields__)
        return cls(**{k: v for k, v in data.items() if k in known and v is not None})

    @classmethod
    def window(cls, amount: float, unit: str, **kwargs: Any) -> FunnelConfig:
        """Config from a window given in hours, days or weeks."""
        return cls(conversion_window_hours=amount * HOURS_PER_UNIT[unit], **kwargs)


def check_steps(steps: Sequence[str]) -> list[str]:
    steps = list(steps)
    if len(set(steps)) != len(steps):
        raise ValueError("funnel steps must be distinct")
    return steps
