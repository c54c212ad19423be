"""Jobs: python -m swarmlake {crawl,migrate,sync,web,classify,reclassify,compact,stats,recent,search,show} ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.params import Settings
from .operators import catalog
from .sources.datasource import from_dump, read_dump
from .store import Store
from .streaming import ingest

SYNC_CHUNK = 100_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="swarmlake")
    p.add_argument("--catalog", default=Settings.from_env().catalog)
    jobs = p.add_subparsers(dest="job", required=True)
    jobs.add_parser("migrate").add_argument("dump")
    c = jobs.add_parser("crawl", help="stores the dump files of a folder as a stream, a bounded number a batch")
    c.add_argument("folder")
    c.add_argument("--follow", action="store_true", help="goes on with the files that arrive")
    jobs.add_parser("sync", help="adds what another catalog has").add_argument("source")
    w = jobs.add_parser("web", help="answers requests, a JSON object per row of a text file")
    w.add_argument("requests")
    for name in ("classify", "reclassify", "compact", "stats"):
        jobs.add_parser(name)
    r = jobs.add_parser("recent")
    s = jobs.add_parser("search")
    s.add_argument("q")
    s.add_argument("--limit", type=int, default=20)
    for x in (r, s):
        x.add_argument("--category")
        x.add_argument("--offset", type=int, default=0)
    jobs.add_parser("show").add_argument("infohash")
    return p


def answer(store: Store, request: dict) -> list[str]:
    """Result rows of one request: its `job` and the job's arguments by name."""
    job = request.get("job")
    if job == "stats":
        out = store.stats()
    elif job == "recent":
        out = store.recent(request.get("category"), int(request.get("offset", 0)))
    elif job == "search":
        out = store.search(request["q"], request.get("category"), int(request.get("limit", 20)), int(request.get("offset", 0)))
    elif job == "show":
        out = catalog.point_lookup(store.read("entries"), store.read("categories"), request["infohash"])
    else:
        raise ValueError(f"unknown job {job!r}")
    return [r["json"] for r in out.select(F.to_json(F.struct("*")).alias("json")).collect()]


def main(args: list[str] | None = None, spark: SparkSession | None = None, quiet: bool = False) -> list[str]:
    a = parser().parse_args(args)
    settings = Settings.from_env()
    spark = spark or SparkSession.builder.appName("swarmlake").getOrCreate()
    store = Store(spark, a.catalog)
    lines = []
    if a.job == "migrate":
        store.add(read_dump(spark, a.dump))
    elif a.job == "crawl":
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", settings.batch_files).option("pathGlobFilter", "part-*").load(a.folder)
        store_batch = lambda batch, n: store.add(from_dump(batch).filter(F.length("name") > 0)) and None
        state = f"{a.catalog.rstrip('/')}/_crawl"
        if a.follow:
            ingest.run_timed(files, state, store_batch, settings.flush_seconds).awaitTermination()
        else:
            ingest.run_available(files, state, store_batch)
    elif a.job == "sync":
        other = Store(spark, a.source)
        # Each chunk looks at all stored keys, so there are at most eight. A smaller one's hashes are sent by the driver, in Store.add.
        chunk = max(SYNC_CHUNK, -(-other.total() // 8))
        ingest.with_retry(lambda: sum(ingest.replicate(other.read("entries"), store, chunk)), 3, lambda: time.sleep(5))
    elif a.job in ("classify", "reclassify"):
        store.classify(full=a.job == "reclassify")
    elif a.job == "compact":
        store.compact()
    elif a.job == "web":
        for r in spark.read.text(a.requests).toLocalIterator():
            lines += answer(store, json.loads(r["value"]))
    else:
        lines = answer(store, vars(a))
    if not quiet:
        print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
