"""Job descriptions. They carry names and numbers only; data stays in DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SyncSpec:
    """One entry of a batch sync list: ``table:time_col:window``; no time column means full copy."""

    table: str
    time_col: str | None = None
    window: int | None = None
    unit: str = "day"

    @classmethod
    def parse(cls, text: str, unit: str = "day") -> "SyncSpec":
        table, time_col, window = (text.split(":") + ["", ""])[:3]
        return cls(table.strip(), time_col.strip() or None, int(window) if window.strip() else None, unit)

    @classmethod
    def parse_list(cls, text: str, unit: str = "day") -> list["SyncSpec"]:
        return [cls.parse(item, unit) for item in text.split(",") if item.strip()]


@dataclass(frozen=True)
class CdcSpec:
    """One entry of a change-capture list: ``schema.table.partcol$destschema``."""

    schema: str
    table: str
    part_col: str
    dest_schema: str

    @classmethod
    def parse(cls, text: str) -> "CdcSpec":
        source, dest = text.split("$")
        schema, table, part_col = source.split(".")
        return cls(schema, table, part_col, schema if dest == "auto" else dest)


@dataclass(frozen=True)
class AlertRule:
    """When a failing check notifies: after ``first`` failures, then every ``every``, up to ``cap`` repeats."""

    first: int = 3
    every: int = 60
    cap: int = 5
    recover_at: int = 1


SERVER_RULE = AlertRule()


def api_rule(gap_seconds: int) -> AlertRule:
    """API probes: second failure, then once per ten minutes, up to ten repeats, recovery on the second success."""
    return AlertRule(first=1, every=600 // gap_seconds, cap=10, recover_at=2)


@dataclass(frozen=True)
class ReportSpec:
    """A report: statements that prepare views, the final query, ordered headers."""

    query: str
    preprocess: tuple[tuple[str, str], ...] = ()
    headers: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableCatalog:
    """Tables of one source by name, with their key columns (Parquet carries no primary key)."""

    paths: dict[str, str]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    schema: str = "app"
