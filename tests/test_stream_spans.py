"""Spans with time-outs: batches of files, checked against a plain version."""

from __future__ import annotations

import datetime as dt
import os
import random

from sedge.streaming import streams


def plain(batches, delay, span):
    """Pairs, and rows without a partner that the watermark has passed; rows not after the watermark of the batches before are dropped."""
    seen, tops, mark = [], {}, None
    for batch in batches:
        seen += [r for r in batch if r[2] is not None and (mark is None or r[2] > mark)]
        for _, _, at, kind in batch:
            if at is not None:
                tops[kind] = max(tops.get(kind, at), at)
        mark = min(tops.values()) - delay if len(tops) == 2 else None
    starts, ends = ([r for r in seen if r[3] == kind] for kind in ("s", "e"))
    pairs = {(s[0], e[0], round((e[2] - s[2]).total_seconds(), 3)) for s in starts for e in ends if s[1] is not None and s[1] == e[1] and s[2] <= e[2] <= s[2] + span}
    return pairs | {(s[0], None, None) for s in starts if s[0] not in {p[0] for p in pairs} and s[2] + span < mark} | {(None, e[0], None) for e in ends if e[0] not in {p[1] for p in pairs} and e[2] < mark}


def test_spans_with_timeouts_keep_their_state_in_one_table(spark, tmp_path):
    rng, zero = random.Random(5), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    batches = []
    for day in range(6):
        rows = [(1000 * day + i, rng.choice([1.0, 2.0, 3.0, 4.0, None]), zero + dt.timedelta(hours=24 * (day - rng.choice([0, 0, 0, 1, 3])), minutes=rng.randrange(0, 1440, 10)), rng.choice("se")) for i in range(60)]
        rows += [(1000 * day + 900, 1.0, None, "s"), (1000 * day + 901, 2.0, None, "e")]
        batches.append(rows)
        path = str(tmp_path / "in" / f"part-{day}.parquet")
        os.makedirs(tmp_path / "in", exist_ok=True)
        spark.createDataFrame(rows, "id long, who double, ts timestamp, kind string").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + 60 * day,) * 2)
    schema = "id long, who double, ts timestamp, kind string"
    every = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    every = streams.with_time(every, "ts", "1 day")
    root = str(tmp_path / "root")
    out = streams.run(streams.span_join(every.filter("kind = 's'"), every.filter("kind = 'e'"), entity="who", ts="ts", id="id", within="1 HOUR", unmatched=True), mode="append", name="spans", root=root)
    got = [tuple(r) for r in out.select("start_id", "end_id", "seconds").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(batches, dt.timedelta(days=1), dt.timedelta(hours=1))
    assert any(a is None for a, _, _ in got) and any(b is None for _, b, _ in got) and any(a and b for a, b, _ in got)
    assert not os.path.exists(f"{root}/log/state")  # no store per task and side
