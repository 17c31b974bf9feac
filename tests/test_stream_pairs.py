import random

import pytest

from kelpwood.streaming.pairs import paired_stream

SCHEMA = "sample string, mate int, at long, seq string, ok boolean"


def plain(rows, lag):
    """Pairs of a sample's sides read to the end, and how it ended (None: still open)."""
    sides, parsed, ended = [], [], []
    for m in (1, 2):
        mine = sorted((r for r in rows if r[1] == m), key=lambda r: r[2])
        cut = next((i for i, r in enumerate(mine) if r[4] is not True), len(mine))
        sides.append([r[3] for r in mine[:cut]])
        parsed.append(bool(cut) or (cut < len(mine) and mine[cut][4] is False))
        ended.append(cut < len(mine))
    if any(r[2] == -1 for r in rows):
        return [], "rejected"
    n = min(map(len, sides))
    pairs = list(zip(sides[0][:n], sides[1][:n]))
    if all(ended) and not all(parsed):
        return pairs, "rejected"
    if all(parsed) and any(e and len(s) == n for e, s in zip(ended, sides)):
        return pairs, "done"
    return pairs, "drifted" if max(len(s) - n for s in sides) > lag else None


def sample(name, left, right, marks=(True, True)):
    """Rows of both sides; a number in a side is the place of a broken record."""
    rows = []
    for m, (n, bad) in ((1, left), (2, right)):
        rows += [(name, m, 10 * i, None if i == bad else f"{name}{m}:{i}", i != bad) for i in range(n)]
        if marks[m - 1]:
            rows.append((name, m, 10 * n, None, None))
    return rows


SAMPLES = {
    "equal": sample("equal", (30, None), (30, None)), "longer": sample("longer", (50, None), (20, None)), "other": sample("other", (20, None), (45, None)),
    "broken": sample("broken", (40, 12), (40, None)), "both": sample("both", (40, 30), (40, 10)), "empty": sample("empty", (0, None), (10, None)),
    "open": sample("open", (25, None), (10, None), (True, False)), "late": sample("late", (15, None), (15, None)),
    "rejected": [("rejected", 1, -1, None, False), *sample("x", (5, None), (5, None))[6:]], "drift": sample("drift", (90, None), (3, None), (False, False)),
}
SAMPLES["rejected"] = [("rejected", *r[1:]) for r in SAMPLES["rejected"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sides_read_to_the_end(spark, tmp_path, seed):
    r = random.Random(seed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Each side's rows come in their order, in batches of their own; the late sample's second side comes last.
    batches = [[] for _ in range(4)]
    for name, rows in SAMPLES.items():
        for m in (1, 2):
            mine = [x for x in rows if x[1] == m]
            cuts = sorted(r.randrange(len(mine) + 1) for _ in range(3)) if (name, m) != ("late", 2) else [0, 0, 0]
            for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(mine)])):
                batches[b] += mine[i:j]

    def run():
        stream = paired_stream(spark.readStream.schema(SCHEMA).parquet(folder), lag=60)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    for b in batches:
        spark.createDataFrame(r.sample(b, len(b)), SCHEMA).coalesce(2).write.mode("append").parquet(folder)
        run()  # from the checkpoint each time
    got = {}
    for x in spark.read.parquet(out).orderBy("sample", "idx").collect():
        got.setdefault(x.sample, []).append(x)
    for name, rows in SAMPLES.items():
        pairs, end = plain(rows, 60)
        mine = got.get(name, [])
        assert [x.kind for x in mine if x.kind != "pair"] == ([end] if end else []), name
        if end != "drifted":
            assert [(x.r1, x.r2) for x in mine if x.kind == "pair"] == pairs and [x.idx for x in mine if x.kind == "pair"] == list(range(len(pairs))), name
