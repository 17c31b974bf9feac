import glob
import gzip

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kelpwood.sources import fastq as fq


def rows(df):
    return sorted((x.idx, x.name, x.seq, x.ok) for x in df.collect())


def test_texts_with_and_without_a_last_line_end(spark):
    text = "@a x\nAC\n+\nII\n@b\nACG\n+b\nIII"
    for t in (text, text + "\n", text.replace("\n", "\r\n")):
        df = spark.createDataFrame([(1, t)], "f long, text string")
        assert rows(fq.fastq_records(df)) == [(0, "a", "AC", True), (1, "b", "ACG", True)]


def test_a_broken_record_ends_its_text(spark):
    text = "@a\nAC\n+\nII\n@b\nACG\n+\nI\n@c\nA\n+\nI\n"
    df = spark.createDataFrame([(1, text), (2, "@a\nA\n+\nI"), (3, ""), (4, None), (5, "@a\nAC\n")], "f long, text string")
    kept = fq.until_broken(fq.fastq_records(df), ["f"])
    assert sorted((x.f, x.name) for x in kept.collect()) == [(1, "a"), (2, "a")]


def test_files_plain_gzip_and_fasta(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@b\nACG\n+\nIII\n@c\nAC\n+\nI\n@d\nA\n+\nI\n"))
    (tmp_path / "c.fa").write_text(">c1 d\nAC\nGT\n>c2\nA")
    df = fq.read_fastq(spark, str(tmp_path))
    got = sorted((x.path.rsplit("/", 1)[1], x.idx, x.name, x.seq, x.ok) for x in df.collect())
    assert got == [("a.fq", 0, "a", "AC", True), ("b.fq.gz", 0, "b", "ACG", True), ("b.fq.gz", 1, None, None, False), ("b.fq.gz", 2, "d", "A", True), ("c.fa", 0, "c1", "ACGT", True), ("c.fa", 1, "c2", "A", True)]
    assert sorted(x.name for x in fq.until_broken(df, ["path"]).collect()) == ["a", "b", "c1", "c2"]


def test_caps_cross_blocks(spark):
    data = [("f", i, 10) for i in range(50)] + [("g", i, 1000) for i in range(3)]
    df = spark.createDataFrame(data, "f string, i long, n long")
    got = fq.capped(df, "f", "i", "n", 20, 1500, block=7).groupBy("f").count().collect()
    assert {x.f: x["count"] for x in got} == {"f": 20, "g": 2}
    assert fq.capped(df, "f", "i", "n", 100, 95, block=7).filter("f = 'f'").count() == 10


def test_streams_replace_a_batch_that_runs_again(spark, tmp_path):
    from kelpwood.streaming.sketches import drain, stream_table

    spark.range(100).repartition(5).write.parquet(str(tmp_path / "in"))
    got = drain(stream_table(spark, str(tmp_path / "in")), lambda x: x, str(tmp_path / "out"))
    assert sorted(x.id for x in got.collect()) == list(range(100))


def test_a_stream_of_small_files_is_one_batch(spark, tmp_path):
    """Batches come one after another: as many as there are files would leave cores idle."""
    from kelpwood.streaming.sketches import drain, stream_table

    spark.range(100).repartition(5).write.parquet(str(tmp_path / "in"))
    for name, of, batches in (("all", {}, 1), ("each", {"files_per_batch": 1}, 5)):
        got = drain(stream_table(spark, str(tmp_path / "in"), **of), lambda x: x, str(tmp_path / name))
        assert sorted(r.id for r in got.select("id").collect()) == list(range(100))
        assert len(list((tmp_path / name / "batches").glob("batch=*"))) == batches


def test_lengths_of_reads_are_known_without_their_bases(spark):
    from compare import DATA
    from pyspark.sql import functions as F

    from kelpwood.plans import inputs as I

    count = lambda df: sorted(df.groupBy("sample", "length").count().collect(), key=str)
    lengths = I.read_lengths(spark, DATA)
    assert count(lengths) == count(I.reads(spark, DATA).select("sample", F.length("seq").alias("length")))
    assert "md5" not in lengths._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_a_streamed_file_are_worth_a_task(spark, monkeypatch):
    from compare import DATA

    from kelpwood.plans import records
    from kelpwood.sources import sequences as sq

    made, stream = [], sq.stream_sequences
    monkeypatch.setattr(sq, "stream_sequences", lambda *a, **b: made.append(b["split_bytes"]) or stream(*a, **b))
    assert records.QUERIES["stream_fastq"](spark, DATA).count() > 0 and made[0] >= 16_000_000


def test_large_samples_are_written_in_as_many_files_as_their_size_asks_for(spark, tmp_path):
    """No task has a fixed share of a sample; each file is in hash order, small samples have few files."""
    from kelpwood.sources.stores import read_samples, write_samples

    name, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(tmp_path / "samples")
    before = spark.conf.get(name)
    rows = spark.range(0, 400_000, 1, 40).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("sample"), F.shiftrightunsigned(F.xxhash64("id"), 6).alias("h"), (F.col("id") % 5).alias("cnt"))
    try:
        spark.conf.set(name, "32k")
        write_samples(rows, path, 21, 20)
    finally:
        spark.conf.set(name, before)
    files = {s: glob.glob(f"{path}/sample={s}/*.parquet") for s in ("large", "small")}
    assert len(files["large"]) > 32 and sum(pq.read_metadata(f).num_rows for f in files["large"]) == 399_600
    for f in files["large"] + files["small"]:
        h = pq.read_table(f, columns=["h"], partitioning=None).column("h").to_pylist()
        assert h == sorted(h)
    assert read_samples(spark, path, 21, 20).exceptAll(rows).count() == 0 and read_samples(spark, path, 21, 20).count() == 400_000
