"""Bookmarks from a stream that stops and goes on are those of the whole table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame

from folioscope.streaming import bookmarks

SCHEMA = "surahNumber int, verseNumber int, timestamp timestamp, event_id long"


def events(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    out = [(r.choice([1, 1, 1, 2, 3]), r.randrange(4), datetime(2024, 1, 1) + timedelta(seconds=30 * k + r.randrange(-300, 300)), k) for k in range(n)]
    return [x for k, x in enumerate(out) for _ in range(1 + (k % 10 == 0))]  # some are sent twice


def of_batch(rows: list[tuple]) -> dict:
    own: dict = {}
    for s, v, at, k in set(rows):
        own.setdefault((s, v), []).append((at, k))
    return {key: max(x)[0] for key, x in own.items() if len(x) % 2}


def found(df: DataFrame) -> dict:
    return {(r["surahNumber"], r["verseNumber"]): r["timestamp"] for r in df.collect()}


def test_stop_and_restart_equal_the_batch(session, tmp_path) -> None:
    rows, source = events(1), str(tmp_path / "events")
    where = (str(tmp_path / "states"), str(tmp_path / "checkpoint"))
    parts = [rows[k : k + 60] for k in range(0, len(rows), 60)]

    def arrive(some: list[list[tuple]]) -> None:
        for part in some:
            session.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run() -> None:
        stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        bookmarks.start(stream, *where).awaitTermination()

    arrive(parts[:4])
    run()
    first = found(bookmarks.bookmarked(bookmarks.current(session.read.parquet(where[0]))))
    assert first == of_batch([x for p in parts[:4] for x in p])
    arrive(parts[4:])
    run()
    run()  # nothing new
    assert found(bookmarks.bookmarked(bookmarks.current(session.read.parquet(where[0])))) == of_batch(rows)
    assert found(bookmarks.bookmarked(bookmarks.states(session.createDataFrame(rows, SCHEMA)))) == of_batch(rows)
    assert len(list(Path(where[0]).glob("batch=*"))) >= len(parts)


def test_a_batch_that_is_run_again_changes_nothing(session, tmp_path) -> None:
    rows = events(2, 50)
    states = bookmarks.states(session.createDataFrame(rows, SCHEMA))
    for _ in range(2):
        states.write.mode("overwrite").parquet(str(tmp_path / "batch=0"))
    assert found(bookmarks.bookmarked(bookmarks.current(session.read.parquet(str(tmp_path))))) == of_batch(rows)
