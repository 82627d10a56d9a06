"""Named operators, configuration, and the runner that starts them over a stream."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning, windows
from ..schema import RESULT_KEYS
from ..sources.packets import stream_packets
from ..streaming import dispatch
from ..streaming.sinks import start_sink
from ..streaming.tables import SnapshotTable, retain_all

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    """Settings of a run; lengths in seconds."""

    input_path: str = "data/stream_in"
    output_path: str = "serving"
    checkpoint_root: str = "checkpoints"
    windows_s: tuple[int, ...] = (10, 30, 60)
    watermark_s: int = 30
    trigger_s: int | None = 5
    max_files: int = 100
    top_ports: int = 20
    enabled: tuple[str, ...] | None = None
    plugins: tuple[str, ...] | None = None
    filters: tuple[dict, ...] = field(default_factory=tuple)


def parse_env(text: str) -> Any:
    """JSON where it is JSON, true and false in any case, else the text. 1 and 0 are numbers."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return json.loads(text)
    except ValueError:
        return text


def load_config(path: str | None = None, prefix: str = "PACKETLOOM_") -> Config:
    """Defaults, then a YAML file, then environment variables with ``prefix``."""
    import yaml

    given: dict[str, Any] = {}
    if path and Path(path).exists():
        given |= yaml.safe_load(Path(path).read_text()) or {}
    given |= {k[len(prefix) :].lower(): parse_env(v) for k, v in os.environ.items() if k.startswith(prefix)}
    known = Config.__dataclass_fields__
    made = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
    for k in set(given) - set(known):
        log.warning("unknown setting %s", k)
    return replace(Config(), **made)


@dataclass(frozen=True)
class Operator:
    """A plan from cleaned packets to a result table; the same for batches and streams."""

    name: str
    table: str
    build: Callable[[DataFrame, int, Config], DataFrame]


_registry: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    if not isinstance(op, Operator):
        raise TypeError(f"not an operator: {op!r}")
    _registry[op.name] = op
    return op


def clear() -> None:
    _registry.clear()


def enabled(names: Sequence[str] | None) -> list[Operator]:
    """Those named, in order; None is all, an empty list none; unknown names are logged."""
    if names is None:
        return list(_registry.values())
    for n in names:
        if n not in _registry:
            log.warning("unknown operator %s", n)
    return [_registry[n] for n in names if n in _registry]


def register_defaults() -> None:
    for name, f in (
        ("window_metrics", windows.window_metrics), ("protocol_counts", windows.protocol_counts), ("port_counts", windows.port_counts), ("distinct_counts", windows.distinct_counts),
        ("moments", windows.moments), ("ip_edges", windows.ip_edges), ("source_stats", windows.source_stats),
    ):
        register(Operator(name, name, lambda df, n, c, f=f: f(df, n, c.watermark_s)))
    register(Operator("filter_counts", "filter_counts", lambda df, n, c: windows.filter_counts(df, cleaning.parse_filters(list(c.filters)), n, c.watermark_s)))
    register(Operator("noop", "noop", lambda df, n, c: df.limit(0) if not df.isStreaming else df.filter("false")))


def result_table(spark: SparkSession, config: Config, table: str, length_s: int) -> SnapshotTable:
    return SnapshotTable(spark, f"{config.output_path}/{table}_{length_s}", RESULT_KEYS[table])


def plugins(config: Config) -> list[dispatch.Plugin]:
    """The plugins of the fan-out that are named, in order; None is all."""
    known = {p.name: p for p in dispatch.default_plugins()}
    names = tuple(known) if config.plugins is None else config.plugins
    for n in names:
        if n not in known:
            log.warning("unknown plugin %s", n)
    return [known[n] for n in names if n in known]


def run(spark: SparkSession, config: Config) -> list[StreamingQuery]:
    """Start every enabled operator for every window length, and the fan-out to the plugins.

    Each query has its own checkpoint and its own tables, which a reader sees whole at every moment (``result_table(...).read()``).
    Operators see valid packets; invalid ones are counted in the fan-out's query and go to its dead letters.
    """
    if not _registry:
        register_defaults()
    cleaned = cleaning.clean(stream_packets(spark, config.input_path, config.max_files))
    valid, _ = cleaning.split_valid(cleaned)
    out = []
    for op in enabled(config.enabled):
        if op.name == "noop":
            continue
        for n in config.windows_s:
            table = result_table(spark, config, op.table, n)

            def write(batch: DataFrame, batch_id: int, table: SnapshotTable = table) -> None:
                ctx = dispatch.Context(batch.sparkSession, table.path, batch_id)
                table.merge(batch, ctx.txn("operator"))

            out.append(start_sink(op.build(valid, n, config), write, f"{config.checkpoint_root}/{op.name}_{n}", trigger_s=config.trigger_s))
    if chosen := plugins(config):
        out.append(dispatch.start_dispatcher(cleaned, f"{config.output_path}/plugins", f"{config.checkpoint_root}/plugins", chosen, config.trigger_s, config.watermark_s))
    return out


def stop(queries: Sequence[StreamingQuery]) -> None:
    """Stop after what is running: each query ends with its batch, none waits for another."""
    for q in queries:
        if q.isActive:
            log.info("stopping %s", q.name or q.id)
            q.stop()


def retain(spark: SparkSession, config: Config, now: str, hours: int = 24) -> dict[str, int]:
    """Delete old windows of every operator's table; rows deleted by table."""
    tables = {f"{op.table}_{n}": result_table(spark, config, op.table, n) for op in enabled(config.enabled) if op.name != "noop" for n in config.windows_s}
    return retain_all({k: t for k, t in tables.items() if t.versions()}, now, hours)
