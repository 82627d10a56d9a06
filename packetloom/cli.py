"""python -m packetloom.cli init|status|verify|compact|run: storage and ingestion from a shell."""

from __future__ import annotations

import argparse
import json
import signal

from .operators import history
from .plans import registry
from .session import get_spark
from .sources.serving import Layout
from .streaming.sinks import write_report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("init", "status", "verify", "compact", "run"))
    p.add_argument("--root", default="data")
    p.add_argument("--report")
    p.add_argument("--date")
    p.add_argument("--hour", type=int)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = get_spark("packetloom")
    layout = Layout(a.root)
    if a.command == "init":
        out: dict = layout.create(spark)
    elif a.command == "compact":
        date, hour = history.select_hour(a.date, a.hour)
        n, m = history.compact_hour(spark, layout.zone("raw"), layout.zone("historical"), date, hour)
        out = {"date": date, "hour": hour, "rows_in": n, "rows_out": m}
    elif a.command == "run":
        queries = registry.run(spark, registry.load_config(a.config))
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: registry.stop(queries))
        for q in queries:
            q.awaitTermination()
        return 0
    else:
        out = history.verify_files(spark, layout.zone("stream_in")).first().asDict()
        if a.command == "status":
            out = {k: out[k] for k in ("files", "records", "last_event", "freshness_s")}
    print(json.dumps(out, default=str, sort_keys=True))
    if a.report:
        write_report(out, a.report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
