import pytest

from kelpwood.streaming import resumable as m

SCHEMA = "sample string, genome long, value double"


def table(spark, names, k):
    return spark.createDataFrame([(s, g, float(k)) for s in names for g in range(3)], SCHEMA)


def test_failures_keep_their_reason_and_only_they_run_again(spark, tmp_path):
    plan, path, seen = spark.createDataFrame([(s,) for s in "abcdefg"], "sample string"), str(tmp_path / "x"), []

    def work(some):
        names = sorted(r.sample for r in some.collect())
        seen.append(names)
        if "c" in names and len(seen) < 6:
            raise ValueError("no such accession")
        return table(spark, names, len(seen))

    assert m.run_plan(plan, work, path, step=3) == 1
    assert [r.reason for r in m.latest(m.commits(spark, path)).filter("state = 'failed'").collect()] == ["no such accession"]
    half = m.grown_table(plan, path, SCHEMA).collect()
    assert {r.sample for r in half if not r.finished} == {"c"} and sum(r.finished for r in half) == 18
    before = len(seen)
    assert m.run_plan(plan, work, path, step=3) == 0 and seen[before:] == [["c"]]
    assert m.run_plan(plan, work, path, step=3) == 0 and len(seen) == before + 1
    done = m.grown_table(plan, path, SCHEMA).collect()
    assert len(done) == 21 and all(r.finished for r in done)


def test_rows_that_were_never_committed_do_not_count(spark, tmp_path, monkeypatch):
    plan, path = spark.createDataFrame([(s,) for s in "abcd"], "sample string"), str(tmp_path / "x")

    def lost(*_):
        raise KeyboardInterrupt

    def work(some):
        return table(spark, [r.sample for r in some.collect()], 1)

    with monkeypatch.context() as patch:
        # Killed between the rows and their commit.
        patch.setattr(spark, "createDataFrame", lambda rows, schema, make=spark.createDataFrame: lost() if schema == m.COMMITS else make(rows, schema))
        with pytest.raises(KeyboardInterrupt):
            m.run_plan(plan, work, path, step=2)
    assert m.grown_table(plan, path, SCHEMA).filter("finished").count() == 0
    assert m.run_plan(plan, work, path, step=3) == 0
    rows = m.grown_table(plan, path, SCHEMA).collect()
    assert sorted((r.sample, r.genome) for r in rows) == [(s, g) for s in "abcd" for g in range(3)]
