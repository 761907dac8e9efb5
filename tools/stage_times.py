"""Summarise stage wall times from a Spark event log folder (bench.py with
BENCH_EVENT_LOG_DIR).  Usage: python tools/stage_times.py DIR [top_n]"""

from __future__ import annotations

import collections
import json
import os
import sys


def lines(path: str):
    """Event-log lines; Spark 4 compresses logs with zstd by default."""
    if path.endswith(".zstd") or path.endswith(".zst"):
        import io
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def event_files(root: str):
    for dirpath, _, files in os.walk(root):
        for f in sorted(files):
            if f.startswith("events_"):
                yield os.path.join(dirpath, f)


def scopes(info) -> str:
    """Operator names of a stage's RDDs (e.g. Exchange, WholeStageCodegen)."""
    names = []
    for r in info.get("RDD Info", []):
        sc = r.get("Scope")
        if sc:
            n = json.loads(sc).get("name", "")
            if n and n not in names:
                names.append(n)
    return ", ".join(names[:4])


def main() -> None:
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    for path in event_files(root):
        for line in lines(path):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                ms = info["Completion Time"] - info["Submission Time"]
                stages.append((ms, info["Stage ID"], info["Number of Tasks"], scopes(info)))
    print(f"{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.2f} s summed (stages overlap)")
    for ms, sid, n, sc in sorted(stages, reverse=True)[:top]:
        print(f"{ms / 1000:8.2f} s  stage {sid:4d}  {n:5d} tasks  {sc}")


if __name__ == "__main__":
    main()
