"""Documented log families: column types and which columns must be present."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogFamily:
    name: str
    schema: T.StructType
    required: tuple[str, ...]

    @property
    def optional(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema if f.name not in self.required)

    def check(self, columns) -> None:
        missing = [c for c in self.required if c not in columns]
        if missing:
            raise ValueError(f"{self.name}: missing required columns {missing}")


def _family(name: str, required: tuple[str, ...], **columns: T.DataType) -> LogFamily:
    return LogFamily(name, T.StructType([T.StructField(c, t) for c, t in columns.items()]), required)


_TS, _TEXT, _INT, _LONG, _REAL = T.TimestampType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# fixed values: column layouts of the three log families
LOG_FAMILIES = {
    "netflow": _family(
        "netflow",
        ("timestamp", "src_ip", "dst_ip", "bytes", "packets"),
        timestamp=_TS, src_ip=_TEXT, dst_ip=_TEXT, src_port=_INT, dst_port=_INT,
        protocol=_TEXT, bytes=_LONG, packets=_LONG, duration=_REAL, flags=_TEXT,
    ),
    "system": _family(
        "system",
        ("timestamp", "event_id", "level"),
        timestamp=_TS, event_id=_INT, level=_TEXT, source=_TEXT, message=_TEXT, user=_TEXT, process=_TEXT,
    ),
    "auth": _family(
        "auth",
        ("timestamp", "user", "action"),
        timestamp=_TS, user=_TEXT, action=_TEXT, src_ip=_TEXT, success=_INT, session_id=_TEXT,
    ),
}
