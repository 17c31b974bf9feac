"""Archive runs, samples and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_missing

# Library strategies and sources whose reads don't cover genomes evenly.
UNSUITABLE_STRATEGY = {"AMPLICON": "amplicon", "RNA-SEQ": "transcripts", "WXS": "exome capture", "TARGETED-CAPTURE": "panel capture", "BISULFITE-SEQ": "bisulfite", "HI-C": "contacts", "CHIP-SEQ": "bound regions", "ATAC-SEQ": "open chromatin"}
UNSUITABLE_SOURCE = {"METATRANSCRIPTOMIC": "transcripts", "TRANSCRIPTOMIC": "transcripts"}

#: Points of a block of time, about, over all users.
BLOCK_ROWS = 200_000


def library_warning(strategy: Column, source: Column) -> Column:
    """Why a library won't profile well, or "" if nothing is known against it."""
    look = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(F.trim(c)))
    return F.coalesce(look(UNSUITABLE_STRATEGY, strategy), look(UNSUITABLE_SOURCE, source), F.lit(""))


def run_files(rows: DataFrame, allowed: str) -> DataFrame:
    """Rows (run, layout, urls, sizes) with ";"-parallel lists to (run, layout,
    n_files, names, bytes, unknown, usable).

    Places are kept, so an empty URL takes its size along; files on hosts other
    than ``allowed`` (and its subdomains) are left out; a size that is no positive
    number is unknown, never zero. Paired runs take _1 and _2; if just one of
    them is there they are single; with neither the first two files; else single.
    """
    urls, sizes = F.split("urls", ";"), F.split("sizes", ";")
    plain = lambda u: F.regexp_replace(F.trim(u), r"^[a-zA-Z]+://", "")
    files = F.zip_with(urls, sizes, lambda u, s: F.struct(plain(u).alias("url"), F.trim(s).try_cast("bigint").alias("n")))
    files = F.filter(files, lambda f: f["url"].isNotNull())
    host = lambda f: F.substring_index(f["url"], "/", 1)
    files = F.filter(files, lambda f: (f["url"] != "") & host(f).rlike(rf"(^|\.){allowed}$"))
    named = F.transform(files, lambda f: F.struct(F.substring_index(f["url"], "/", -1).alias("name"), F.when(f["n"] > 0, f["n"]).alias("n")))
    out = rows.select("run", F.upper(F.trim("layout")).alias("declared"), named.alias("files"))
    mate = lambda k: F.try_element_at(F.filter("files", lambda f: f["name"].rlike(rf"(?i)_{k}\.(fastq|fq)(\.gz)?$")), F.lit(1))
    out = out.withColumns({"r1": mate(1), "r2": mate(2)})
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    kept = (
        F.when(F.col("declared") != "PAIRED", F.col("files")).when(both, F.array("r1", "r2"))
        .when(F.coalesce("r1", "r2").isNotNull(), F.array(F.coalesce("r1", "r2"))).otherwise(F.slice("files", 1, 2))
    )
    out = out.withColumn("kept", kept)
    paired = (F.col("declared") == "PAIRED") & (both | (F.coalesce("r1", "r2").isNull() & (F.size("files") >= 2)))
    return out.select(
        "run", F.when(paired, "PAIRED").otherwise("SINGLE").alias("layout"), F.size("kept").alias("n_files"), F.array_join(F.transform("kept", lambda f: f["name"]), ",").alias("names"),
        F.aggregate("kept", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["n"], F.lit(0))).alias("bytes"), F.size(F.filter("kept", lambda f: f["n"].isNull())).alias("unknown"), (F.size("kept") > 0).alias("usable"),
    )


def read_count_verdict(observed: Column, listed: Column, paired: Column, cap: Column) -> Column:
    """ok, capped, short or long: a tolerance of one percent, one read at least;
    lists of paired runs may count pairs or reads."""
    expected = F.when(paired, F.round(listed / 2)).otherwise(listed)
    fits = lambda want: F.abs(want - observed) <= F.greatest(F.lit(1.0), want * 0.01)
    good = fits(expected) | (paired & fits(expected * 2))
    return F.when(observed >= cap, "capped").when(listed.isNull() | (expected <= 0), "ok").when(good, "ok").when(observed < expected, "short").otherwise("long")


def download_estimate(runs: DataFrame, by: str, cap: int, rate: int = 4 * 1024 * 1024) -> DataFrame:
    """Per ``by``, over runs (bytes, reads): bytes to fetch, prorated where the cap is
    below a run's reads; runs of unknown size; and the seconds if all sizes are known."""
    part = F.when(F.col("reads") > cap, F.ceil(F.col("bytes") * (cap / F.col("reads")))).otherwise(F.col("bytes"))
    sums = runs.groupBy(by).agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("unknown"), F.coalesce(F.max((F.col("reads") > cap) & F.col("bytes").isNotNull()), F.lit(False)).alias("capped"))
    good = (F.col("unknown") == 0) & (F.col("bytes") > 0)
    return sums.withColumns({"estimable": good, "seconds": F.when(good, F.col("bytes") / rate)})


def field_facts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, n_values, value): how many samples fill a field, and its value
    if all fill it alike."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("x.*")
    used = long.withColumn("v", F.when(~is_missing(F.col("v")), F.trim("v")))
    sums = used.groupBy("field").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("n_values"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    return sums.select("field", "filled", "n_values", F.when((F.col("n_values") == 1) & (F.col("filled") == F.col("n")), F.col("least")).alias("value"))


def _in_blocks(points: DataFrame, least_us: int = 1) -> tuple[DataFrame, int, int]:
    """Points with the number of their block of time, the first instant and a block's length
    (least_us or more): about BLOCK_ROWS points of all users in each. Points without a time come first."""
    seen = points.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("us").alias("n")).first()
    lo, hi = seen["lo"] or 0, seen["hi"] or 0
    length = max(least_us, (hi - lo) // (seen["n"] // BLOCK_ROWS + 1) + 1)
    return points.withColumn("block", F.coalesce(F.expr(f"(us - {lo}L) div {length}L"), F.lit(-1))), lo, length


def trailing_rate(points: DataFrame, by: str, seconds: float, least_span: float = 0.25) -> DataFrame:
    """Points (id, us, amount) with the rate of what came within the last ``seconds``;
    null while they span no more than least_span seconds.

    Running sums are taken in blocks of time, from the sum of the blocks before; a
    block also gets the points of the one before that its first ones look back to."""
    reach = int(seconds * 1_000_000)
    rows, lo, length = _in_blocks(points, reach + 1)
    earlier = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(by, "block").agg(F.sum("amount").alias("own")).select(F.col(by).alias("of"), F.col("block").alias("at"), F.sum("own").over(earlier).alias("before"))
    so_far = Window.partitionBy(by, "block").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("amount").over(so_far)).join(before, F.col(by).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    rows = rows.withColumn("total", F.coalesce(F.col("before") + F.col("within"), "within", "before"))
    seen_next = (F.col("block") >= 0) & (F.col("us") >= F.lit(lo) + (F.col("block") + 1) * length - reach)
    rows = rows.select(by, "id", "us", "total", "block", F.explode(F.when(seen_next, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("later"))
    recent = Window.partitionBy(by, "block").orderBy("us").rangeBetween(-reach, 0)
    rows = rows.withColumn("block", F.col("block") + F.col("later"))
    rows = rows.withColumns({"span": (F.col("us") - F.min("us").over(recent)) / 1_000_000, "gained": F.col("total") - F.min("total").over(recent)}).filter("later = 0")
    return rows.select("id", F.when(F.col("span") > least_span, F.col("gained") / F.col("span")).alias("rate"))


def smoothed(points: DataFrame, by: str, keep: float = 0.8) -> DataFrame:
    """The last exponentially smoothed amount of each ``by``, in the order of (us, id).

    A grouped sum: an amount weighs (1 - keep) * keep^k with k amounts after it, the
    first one keep^k. k is counted in blocks of time, then in the block."""
    rows, _, _ = _in_blocks(points)
    counts = rows.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("of"), F.col("block").alias("at"), "n", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later"), F.sum("n").over(first).isNull().alias("starts"))
    rank = F.row_number().over(Window.partitionBy(by, "block").orderBy(F.desc("us"), F.desc("id"), F.desc("amount")))
    rows = rows.withColumn("rank", rank).join(counts, F.col(by).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    weight = F.pow(F.lit(keep), F.col("later") + F.col("rank") - 1) * F.when(F.col("starts") & (F.col("rank") == F.col("n")), 1.0).otherwise(1 - keep)
    total = F.when(F.count("amount") == F.count(F.lit(1)), F.sum(F.col("amount") * weight))
    return rows.groupBy(by).agg(total.alias("smoothed"))


def pair_up(files: DataFrame) -> DataFrame:
    """Files (key, mate, name) to (key, r1, r2): mates by their place among the key's
    files; files without a partner have a null one."""
    place = F.row_number().over(Window.partitionBy("key", "mate").orderBy("name"))
    rows = files.withColumn("place", place)
    side = lambda m: rows.filter(F.col("mate") == m).select("key", "place", F.col("name").alias(f"r{m}"))
    return side(1).join(side(2), ["key", "place"], "full_outer").select("key", "r1", "r2")


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two manifests that the other lacks, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def assign_samples(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (id, name) to (id, name, sample, layout, mate): as a manifest (name,
    sample, layout, mate; one row a name) says; else a mate's file belongs to the
    key that its mates share; else a file is a sample of its own."""
    from ..functions.names import mate_key, without_endings

    key, mate = mate_key(F.col("name"))
    known = manifest.select("name", *[F.col(c).alias(f"known_{c}") for c in ("sample", "layout", "mate")])
    rows = files.withColumns({"key_": key, "mate_": mate}).join(known, "name", "left")
    found = F.col("known_sample").isNotNull()
    return rows.select(
        "id", "name", F.coalesce("known_sample", "key_", without_endings(F.col("name"))).alias("sample"),
        F.when(found, F.col("known_layout")).when(F.col("key_").isNotNull(), "PAIRED").otherwise("SINGLE").alias("layout"),
        F.when(found, F.col("known_mate")).otherwise(F.col("mate_")).alias("mate"),
    )
