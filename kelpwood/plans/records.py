"""Queries on files, records, names, runs, catalogues and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import runs as rn
from ..operators import sketch as sk
from ..operators.ecology import global_rank
from ..sources import fastq as fq
from ..sources import sequences as sq
from ..sources.stores import scratch
from ..streaming import sketches as st
from . import inputs as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def q(s: str) -> str:
    return s.replace("'", "''")


# ---- file names made from parts

_ENDINGS = ["_1.fastq.gz", "_2.fastq.gz", ".R1.fq", "-R2.clean.fq.gz", ".fa", ".fna.gz", ".refdb", ".sample", ".txt", ".FASTA"]
_FILES = "files AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || [" + ", ".join(f"'{e}'" for e in _ENDINGS) + "][p_size % 10 + 1] AS name FROM part)"


def _files(spark, d):
    ending = F.array(*[F.lit(e) for e in _ENDINGS])[F.col("p_size") % 10]
    return I.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("name"))


@query("input_routing", f"""WITH {_FILES} SELECT id, name, CASE WHEN regexp_matches(name, '\\.refdb$') THEN 'database' WHEN regexp_matches(name, '\\.sample$') THEN 'sketch'
WHEN regexp_matches(lower(name), '\\.({nm.FASTQ})(\\.gz)?$') THEN 'fastq' WHEN regexp_matches(lower(name), '\\.({nm.FASTA})(\\.gz)?$') THEN 'fasta' ELSE 'unknown' END AS kind FROM files""")
def input_routing(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).withColumn("kind", nm.route(F.col("name")))


_MATES = rf"""{_FILES}, m AS (SELECT *, regexp_extract(name, '(?i)^(.*)\.(?:{nm.FASTQ})(?:\.gz)?$', 1) AS stem FROM files),
sp AS (SELECT *, string_split_regex(stem, '[._-]') AS l FROM m),
mk AS (SELECT *, list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '^[Rr]?[12]$') AND (i > 2 OR l[1] <> '') AND NOT list_contains(l[i + 1:], ''))[1] AS i FROM sp),
keyed AS (SELECT id, name, CASE WHEN i IS NOT NULL THEN array_to_string(l[1:i - 1], '?') END AS head, i, l, stem FROM mk),
keyed0 AS (SELECT id, name, CASE WHEN i IS NOT NULL THEN stem[1:length(head)] || stem[length(head) + length(l[i]) + 2:] END AS key, CAST(l[i][-1:] AS INT) AS mate FROM keyed)"""


@query("mate_names", f"WITH {_MATES} SELECT * FROM keyed0")
def mate_names(spark: SparkSession, d: str) -> DataFrame:
    key, mate = nm.mate_key(F.col("name"))
    return _files(spark, d).withColumns({"key": key, "mate": mate})


@query("mate_pairing", f"""WITH {_MATES}, p AS (SELECT *, row_number() OVER (PARTITION BY key, mate ORDER BY name, id) AS place FROM keyed0 WHERE key IS NOT NULL),
a AS (SELECT * FROM p WHERE mate = 1), b AS (SELECT * FROM p WHERE mate = 2) SELECT coalesce(a.key, b.key) AS key, a.name AS r1, b.name AS r2 FROM a FULL JOIN b ON a.key = b.key AND a.place = b.place""")
def mate_pairing(spark: SparkSession, d: str) -> DataFrame:
    key, mate = nm.mate_key(F.col("name"))
    return rn.pair_up(_files(spark, d).withColumns({"key": key, "mate": mate}).filter("key is not null"))


@query("names_clean", f"""WITH {_FILES} SELECT id, regexp_replace(regexp_replace(name, '(?i)\\.gz$', ''), '(?i)\\.({nm.FASTQ})$', '') AS base, translate(p_type || chr(9) || p_brand, chr(9), ' ') AS contig FROM files JOIN part ON p_partkey = id""")
def names_clean(spark: SparkSession, d: str) -> DataFrame:
    contig = F.translate(F.concat("p_type", F.lit("\t"), "p_brand"), "\t", " ")
    part = I.table(spark, d, "part").select(F.col("p_partkey").alias("id"), contig.alias("contig"))
    paths = _files(spark, d).withColumn("path", F.concat(F.lit("/data/reads/"), "name"))
    return paths.join(part, "id").select("id", nm.without_endings(nm.basename(F.col("path"))).alias("base"), "contig")


_RAW = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' err' || page_id || ' ' WHEN 2 THEN 'https://archive.example/view/prjeb' || page_id || '?show=reads' ELSE 'run ' || page_id END"


@query("accession_valid", rf"""WITH r AS (SELECT page_id, trim({_RAW}) AS s FROM pages), a AS (SELECT page_id, s, regexp_extract(s, '^https?://\S*/([A-Za-z0-9]+)/?(?:[?#].*)?$', 1) AS t FROM r),
u AS (SELECT page_id, upper(CASE WHEN t <> '' THEN t ELSE s END) AS accession FROM a) SELECT page_id, accession, regexp_matches(accession, '^[A-Z]{{3,6}}[0-9]+$') AS valid FROM u""")
def accession_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "pages").select("page_id", nm.accession(F.expr(_RAW)).alias("accession"))
    return rows.withColumn("valid", nm.is_accession(F.col("accession")))


_HOST = "files.archive.example"
_URLS = f"""CASE o_orderkey % 6 WHEN 0 THEN 'ftp.{_HOST}/a/R' || o_orderkey || '_1.fastq.gz;ftp.{_HOST}/a/R' || o_orderkey || '_2.fastq.gz'
 WHEN 1 THEN 'ftp://{_HOST}/b/R' || o_orderkey || '.fastq.gz' WHEN 2 THEN '{_HOST}/c/R' || o_orderkey || '.fq.gz;;{_HOST}/c/R' || o_orderkey || '_1.fq.gz;{_HOST}/c/R' || o_orderkey || '_2.fq.gz'
 WHEN 3 THEN 'elsewhere.example/R' || o_orderkey || '_1.fastq;{_HOST}/R' || o_orderkey || '_2.fastq' WHEN 4 THEN '' ELSE '{_HOST}/x/a;{_HOST}/x/b;{_HOST}/x/c' END"""
_SIZES = "CASE o_orderkey % 6 WHEN 0 THEN '100;200' WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) WHEN 2 THEN '7;;x;9' WHEN 3 THEN '5;6' WHEN 4 THEN '' ELSE '1;2;3' END"
_LAYOUT = "CASE o_orderstatus WHEN 'O' THEN 'PAIRED' WHEN 'F' THEN ' single' ELSE 'paired' END"


@query("run_rows", rf"""WITH r AS (SELECT o_orderkey AS run, upper(trim({_LAYOUT})) AS declared, string_split({_URLS}, ';') AS u, string_split({_SIZES}, ';') AS s FROM orders),
f AS (SELECT run, declared, unnest(range(len(u))) AS i, regexp_replace(trim(unnest(u)), '^[a-zA-Z]+://', '') AS url, unnest(s) AS s FROM r),
g AS (SELECT run, i, regexp_extract(url, '[^/]*$') AS name, CASE WHEN TRY_CAST(trim(s) AS BIGINT) > 0 THEN TRY_CAST(trim(s) AS BIGINT) END AS n FROM f WHERE url <> '' AND regexp_matches(string_split(url, '/')[1], '(^|\.){_HOST}$')),
m AS (SELECT *, regexp_matches(name, '(?i)_1\.(fastq|fq)(\.gz)?$') AS is1, regexp_matches(name, '(?i)_2\.(fastq|fq)(\.gz)?$') AS is2 FROM g),
k AS (SELECT run, min(i) FILTER (WHERE is1) AS i1, min(i) FILTER (WHERE is2) AS i2, count(*) AS n FROM m GROUP BY run),
o AS (SELECT m.*, row_number() OVER (PARTITION BY run ORDER BY i) AS place FROM m),
c AS (SELECT o.run, o.i, o.name, o.n, CASE WHEN o.i = k.i2 AND k.i1 IS NOT NULL THEN 1 ELSE 0 END AS ord FROM o JOIN k USING (run) JOIN r USING (run)
  WHERE r.declared <> 'PAIRED' OR (i1 IS NOT NULL AND i2 IS NOT NULL AND o.i IN (i1, i2)) OR ((i1 IS NULL) <> (i2 IS NULL) AND o.i = coalesce(i1, i2)) OR (i1 IS NULL AND i2 IS NULL AND place <= 2)),
z AS (SELECT run, count(*) AS n_files, string_agg(name, ',' ORDER BY CASE WHEN (SELECT declared FROM r WHERE r.run = c.run) = 'PAIRED' THEN ord ELSE 0 END, i) AS names, sum(coalesce(n, 0)) AS bytes, count(*) FILTER (WHERE n IS NULL) AS unknown FROM c GROUP BY run)
SELECT r.run, CASE WHEN declared = 'PAIRED' AND ((i1 IS NOT NULL AND i2 IS NOT NULL) OR (i1 IS NULL AND i2 IS NULL AND k.n >= 2)) THEN 'PAIRED' ELSE 'SINGLE' END AS layout,
  coalesce(n_files, 0) AS n_files, coalesce(names, '') AS names, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(unknown, 0) AS unknown, coalesce(n_files, 0) > 0 AS usable FROM r LEFT JOIN z USING (run) LEFT JOIN k USING (run)""")
def run_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.expr(_LAYOUT).alias("layout"), F.expr(_URLS).alias("urls"), F.expr(_SIZES).alias("sizes"))
    return rn.run_files(rows, _HOST.replace(".", r"\."))


# ---- metadata

_COUNTRY = "CASE c_custkey % 6 WHEN 0 THEN 'missing: third party' WHEN 1 THEN 'USA:CA: San Diego' WHEN 2 THEN 'n/a' WHEN 3 THEN ' Not Applicable ' WHEN 4 THEN 'Chile' ELSE c_mktsegment END"
_MISS = f"(lower(trim(x)) IN ({', '.join(repr(m) for m in nm.MISSING)}) OR regexp_matches(lower(trim(x)), '{nm.MISSING_START}'))"


@query("metadata_clean", f"""WITH c AS (SELECT c_custkey, {_COUNTRY} AS x, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_acctbal / 100 END AS lat, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(c_custkey % 180 AS DOUBLE) END AS lon, CASE c_custkey % 3 WHEN 0 THEN 'RANDOM' WHEN 1 THEN 'PCR' ELSE 'unspecified' END AS sel FROM customer),
p AS (SELECT *, list_filter(list_transform(string_split(CASE WHEN NOT {_MISS} THEN trim(x) END, ':'), lambda y: trim(y)), lambda y: y <> '') AS l FROM c)
SELECT c_custkey, l[1] AS country, nullif(array_to_string(l[2:], ', '), '') AS region, CASE WHEN abs(lat) >= 1e-6 OR abs(lon) >= 1e-6 THEN lat END AS lat, CASE WHEN abs(lat) >= 1e-6 OR abs(lon) >= 1e-6 THEN lon END AS lon, CASE WHEN sel = 'PCR' THEN sel END AS selection FROM p""")
def metadata_clean(spark: SparkSession, d: str) -> DataFrame:
    island = F.col("c_custkey") % 11 == 0
    rows = I.table(spark, d, "customer").select(
        "c_custkey", F.expr(_COUNTRY).alias("x"), F.when(island, 0.0).otherwise(F.col("c_acctbal") / 100).alias("lat"), F.when(island, 0.0).otherwise((F.col("c_custkey") % 180).cast("double")).alias("lon"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'RANDOM' WHEN 1 THEN 'PCR' ELSE 'unspecified' END").alias("sel"),
    )
    country, region = nm.country_parts(F.col("x"))
    placed = (F.abs("lat") >= 1e-6) | (F.abs("lon") >= 1e-6)
    selection = F.when(~F.lower(F.col("sel")).isin("random", "unspecified"), nm.cleaned(F.col("sel")))
    return rows.select("c_custkey", country.alias("country"), region.alias("region"), F.when(placed, F.col("lat")).alias("lat"), F.when(placed, F.col("lon")).alias("lon"), selection.alias("selection"))


_FACTS = f"""WITH c AS (SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, substr(c_name, 1, 8) AS prefix, CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE 'paid' END AS state FROM customer),
l AS (SELECT unnest(['segment', 'nation', 'prefix', 'state']) AS field, unnest([segment, nation, prefix, state]) AS x FROM c),
s AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE NOT {_MISS}) AS filled, count(DISTINCT CASE WHEN NOT {_MISS} THEN trim(x) END) AS n_values, min(CASE WHEN NOT {_MISS} THEN trim(x) END) AS least FROM l GROUP BY field)"""


def _facts(spark, d):
    c = I.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.substring("c_name", 1, 8).alias("prefix"), F.when(F.col("c_acctbal") < 0, "n/a").otherwise("paid").alias("state"))
    return rn.field_facts(c, ["segment", "nation", "prefix", "state"])


@query("run_facts", f"{_FACTS} SELECT field, least AS value FROM s WHERE n_values = 1 AND filled = n")
def run_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).filter("value is not null").select("field", "value")


@query("field_coverage", f"{_FACTS} SELECT field, filled, n_values FROM s")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("field", "filled", "n_values")


# ---- events

@query("time_window", "SELECT event_id, (hour(ts) * 60 + minute(ts)) >= 1320 OR (hour(ts) * 60 + minute(ts)) < 360 AS night, (hour(ts) * 60 + minute(ts)) >= 540 AND (hour(ts) * 60 + minute(ts)) < 1050 AS day FROM events")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return I.table(spark, d, "events").select("event_id", nm.in_daily_window(ts, 1320, 360).alias("night"), nm.in_daily_window(ts, 540, 1050).alias("day"))


@query("fnv1a", "SELECT p_partkey, lower(lpad(hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296)), 8, '0')) AS hash FROM part")
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "part").select("p_partkey", nm.fnv1a(F.col("p_name")).alias("hash"))


def _points(spark, d):
    return I.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("amount"))


@query("trailing_rate", """WITH p AS (SELECT event_id AS id, user_id, epoch_us(ts) AS us, value AS amount FROM events), c AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS total FROM p),
w AS (SELECT id, total - min(total) OVER r AS gained, (us - min(us) OVER r) / 1000000 AS span FROM c WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN span > 0.25 THEN round(gained / span, 8) END AS rate FROM w""")
def trailing_rate(spark: SparkSession, d: str) -> DataFrame:
    return rn.trailing_rate(_points(spark, d), "user_id", 86400.0).select("id", F.round("rate", 8).alias("rate"))


@query("smoothed_rate", "WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS l FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(l, lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS smoothed FROM l")
def smoothed_rate(spark: SparkSession, d: str) -> DataFrame:
    return rn.smoothed(_points(spark, d), "user_id").select("user_id", F.round("smoothed", 6).alias("smoothed"))


@query("rank_intern", "WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part WHERE p_brand IS NOT NULL AND p_size > 3 GROUP BY p_brand), i AS (SELECT p_brand, row_number() OVER (ORDER BY first) - 1 AS idx FROM f) SELECT p_partkey, CASE WHEN p_size > 3 THEN idx ELSE -1 END AS idx FROM part LEFT JOIN i USING (p_brand)")
def rank_intern(spark: SparkSession, d: str) -> DataFrame:
    """Brands as dense numbers in the order of their first part; parts up to size 3 have none."""
    part = I.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("brand"))
    first = part.filter("brand is not null").groupBy("brand").agg(F.min("p_partkey").alias("first"))
    index = global_rank(first, "first", name="at").select("brand", (F.col("at") - 1).alias("idx"))
    return part.join(index, "brand", "left").select("p_partkey", F.coalesce("idx", F.lit(-1)).alias("idx"))


# ---- runs from orders

_OBS = "floor(o_totalprice * (0.975 + (o_orderkey % 50) / 1000.0))"


@query("read_count_verdict", """WITH r AS (SELECT o_orderkey, floor(o_totalprice * (0.975::DOUBLE + (o_orderkey % 50) / 1000)) AS observed, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE floor(o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END END AS listed, o_orderkey % 2 = 0 AS paired FROM orders),
e AS (SELECT *, CASE WHEN paired THEN round(listed / 2) ELSE listed END AS expected FROM r)
SELECT o_orderkey, CASE WHEN observed >= 400000 THEN 'capped' WHEN listed IS NULL OR expected <= 0 THEN 'ok' WHEN abs(expected - observed) <= greatest(1, expected * 0.01) OR (paired AND abs(expected * 2 - observed) <= greatest(1, expected * 2 * 0.01)) THEN 'ok' WHEN observed < expected THEN 'short' ELSE 'long' END AS verdict FROM e""")
def read_count_verdict(spark: SparkSession, d: str) -> DataFrame:
    paired = F.col("o_orderkey") % 2 == 0
    observed = F.floor(F.col("o_totalprice") * (F.lit(0.975) + (F.col("o_orderkey") % 50) / 1000))
    listed = F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice") * F.when(paired, 2).otherwise(1))
    return I.table(spark, d, "orders").select("o_orderkey", rn.read_count_verdict(observed, listed, paired, F.lit(400000)).alias("verdict"))


@query("download_estimate", """WITH r AS (SELECT o_custkey AS customer, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 END AS bytes, CAST(floor(o_totalprice) AS BIGINT) AS reads FROM orders),
s AS (SELECT customer, coalesce(sum(CASE WHEN reads > 100000 THEN ceil(bytes * (100000 / reads)) ELSE bytes END), 0) AS bytes, count(*) FILTER (WHERE bytes IS NULL) AS unknown, coalesce(bool_or(reads > 100000 AND bytes IS NOT NULL), false) AS capped FROM r GROUP BY customer)
SELECT customer, CAST(bytes AS BIGINT) AS bytes, unknown, capped, unknown = 0 AND bytes > 0 AS estimable, CASE WHEN unknown = 0 AND bytes > 0 THEN round(bytes / 4194304, 6) END AS seconds FROM s""")
def download_estimate(spark: SparkSession, d: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("long")
    runs = I.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 17 != 0, price * 1000).alias("bytes"), price.alias("reads"))
    return rn.download_estimate(runs, "customer", 100000).withColumn("seconds", F.round("seconds", 6))


_STRATEGIES = ["WGS", "amplicon", "RNA-Seq", " WXS ", "Hi-C", "OTHER", "ATAC-seq", ""]
_WARN = "CASE " + " ".join(f"WHEN s = '{k}' THEN '{v}'" for k, v in rn.UNSUITABLE_STRATEGY.items()) + " " + " ".join(f"WHEN o = '{k}' THEN '{v}'" for k, v in rn.UNSUITABLE_SOURCE.items()) + " ELSE '' END"


@query("library_warning", f"WITH l AS (SELECT o_orderkey, upper(trim([{', '.join(repr(s) for s in _STRATEGIES)}][o_orderkey % 8 + 1])) AS s, CASE o_orderstatus WHEN 'F' THEN 'TRANSCRIPTOMIC' ELSE 'GENOMIC' END AS o FROM orders) SELECT o_orderkey, {_WARN} AS warning FROM l")
def library_warning(spark: SparkSession, d: str) -> DataFrame:
    strategy = F.array(*[F.lit(s) for s in _STRATEGIES])[(F.col("o_orderkey") % 8).cast("int")]
    source = F.when(F.col("o_orderstatus") == "F", "transcriptomic").otherwise("genomic")
    return I.table(spark, d, "orders").select("o_orderkey", rn.library_warning(strategy, source).alias("warning"))


@query("head_cap", """WITH r AS (SELECT doc_id, source, length(text) AS bases, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, bases FROM r WHERE n <= 40 AND before < 60000""")
def head_cap(spark: SparkSession, d: str) -> DataFrame:
    """The head of each source: 40 documents or 60,000 characters, the last one whole."""
    docs = I.table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("bases"))
    return fq.capped(docs, "source", "doc_id", "bases", 40, 60000)


# ---- records

_RECORDS = f"{I.CONTIGS}, rec AS (SELECT genome, row_number() OVER (PARTITION BY genome ORDER BY contig) - 1 AS idx, 'c' || contig AS name, seq FROM contigs)"


def _fastq(spark, d, broken: bool) -> DataFrame:
    """A FASTQ text of each document's contigs; every fifth document misses a quality at its contig 3."""
    bad = (F.col("genome") % 5 == 0) & (F.col("contig") == 3) if broken else F.lit(False)
    quality = F.repeat(F.lit("I"), F.length("seq") - F.when(bad, 1).otherwise(0))
    record = F.concat(F.lit("@c"), F.col("contig").cast("string"), F.lit(" "), F.col("genome").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), quality)
    rows = I.contigs(spark, d).select("genome", F.struct("contig", record.alias("r")).alias("x")).groupBy("genome").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return rows.select("genome", F.array_join(F.transform("l", lambda x: x["r"]), "\n").alias("text"))


@query("fastq_records", f"WITH {_RECORDS} SELECT genome, idx, name, seq FROM rec")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    return fq.fastq_records(_fastq(spark, d, False)).filter("ok").select("genome", "idx", "name", "seq")


@query("fastq_stop", f"WITH {_RECORDS}, bad AS (SELECT genome, min(idx) AS b FROM rec WHERE genome % 5 = 0 AND name = 'c3' GROUP BY genome) SELECT genome, idx, name FROM rec LEFT JOIN bad USING (genome) WHERE b IS NULL OR idx < b")
def fastq_stop(spark: SparkSession, d: str) -> DataFrame:
    return fq.until_broken(fq.fastq_records(_fastq(spark, d, True)), ["genome"]).select("genome", "idx", "name")


@query("fastq_files", f"WITH {I.CONTIGS}, {I.READS}, n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY idx) AS place FROM reads) SELECT sample, CAST(idx AS VARCHAR) AS name, seq, repeat('I', length(seq)) AS qual, true AS ok FROM n WHERE place <= 1000")
def fastq_files(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's first thousand reads, as a down-sampling of reads to files does it: written as gzip FASTQ files and read back."""
    reads = I.reads(spark, d).withColumn("size", F.length("seq"))
    head = fq.capped(reads.withColumn("sample", F.coalesce("sample", F.lit("-"))), "sample", "idx", "size", 1000, 1 << 40)
    path = scratch(spark)
    named = head.select(F.concat_ws("/", "sample", "idx").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    fq.write_fastq(named, path)
    back = fq.read_fastq(spark, path)
    return back.select(F.nullif(F.substring_index("name", "/", 1), F.lit("-")).alias("sample"), F.substring_index("name", "/", -1).alias("name"), "seq", "qual", "ok")


@query("sequence_ranges", f"WITH {I.CONTIGS}, {I.READS} SELECT sample, idx, seq, repeat('I', length(seq)) AS qual, true AS ok FROM reads")
def sequence_ranges(spark: SparkSession, d: str) -> DataFrame:
    """All reads, written as plain FASTQ files and read back in ranges that cut records anywhere."""
    path = _written(spark, I.reads(spark, d))
    return _named(sq.read_sequences(spark, path, split_bytes=RANGE)).select("sample", "idx", "seq", "qual", "ok")


#: Bytes of a range of the FASTQ files: a task has some fixed cost, and ends within a line.
RANGE = 16_000_057


def _written(spark: SparkSession, reads: DataFrame) -> str:
    """Reads (sample, idx, seq) as plain FASTQ files in a folder of their own."""
    path = scratch(spark)
    name = F.concat_ws("/", F.coalesce("sample", F.lit("-")), "idx")
    fq.write_fastq(reads.select(name.alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual")), path, "none")
    return path


def _named(records: DataFrame) -> DataFrame:
    """sample and idx from the names that _written gave."""
    return records.withColumns({"sample": F.nullif(F.substring_index("name", "/", 1), F.lit("-")), "idx": F.substring_index("name", "/", -1).cast("long")})


@query("manifest_lookup", f"""WITH {_MATES}, man AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_1.fastq.gz' AS name, 'M_' || p_brand AS sample, 'PAIRED' AS layout, 1 AS mate FROM part WHERE p_partkey % 5 = 0),
man1 AS (SELECT name, min(sample) AS sample, any_value(layout) AS layout, any_value(mate) AS mate FROM man GROUP BY name)
SELECT id, k.name, coalesce(man1.sample, k.key, regexp_replace(regexp_replace(k.name, '(?i)\\.gz$', ''), '(?i)\\.({nm.FASTQ})$', '')) AS sample,
CASE WHEN man1.name IS NOT NULL THEN man1.layout WHEN k.key IS NOT NULL THEN 'PAIRED' ELSE 'SINGLE' END AS layout, CASE WHEN man1.name IS NOT NULL THEN man1.mate ELSE k.mate END AS mate
FROM keyed0 k LEFT JOIN man1 ON man1.name = k.name""")
def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Files and their samples: by a manifest of some names, else by the mate's marker, else alone."""
    part = I.table(spark, d, "part").filter("p_partkey % 5 = 0")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_1.fastq.gz"))
    manifest = part.groupBy(name.alias("name")).agg(F.concat(F.lit("M_"), F.min("p_brand")).alias("sample")).withColumns({"layout": F.lit("PAIRED"), "mate": F.lit(1)})
    return rn.assign_samples(_files(spark, d), manifest)


@query("paired_reads", f"WITH {I.PAIRS} SELECT idx, r1, r2 FROM pairs")
def paired_reads(spark: SparkSession, d: str) -> DataFrame:
    return I.pairs(spark, d).select("idx", "r1", "r2")


@query("session_roundtrip", "SELECT c_custkey, c_name, c_mktsegment, [c_acctbal, CAST(c_nationkey AS DOUBLE)] AS numbers FROM customer")
def session_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Customers in a JSON session of a fixed schema, written and read back strictly."""
    rows = I.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("numbers"))
    path = scratch(spark)
    rows.withColumn("format", F.lit(1)).write.json(path)
    schema = "format int, c_custkey long, c_name string, c_mktsegment string, numbers array<double>"
    back = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return back.filter("format = 1").drop("format")


@query("tsv_parse", "SELECT p_partkey AS genome, p_type AS contig, round(p_retailprice, 4) AS abundance FROM part")
def tsv_parse(spark: SparkSession, d: str) -> DataFrame:
    """A table written as TSV with other columns around, and read by its header's names."""
    part = I.table(spark, d, "part")
    path = scratch(spark)
    rows = part.select(F.col("p_brand").alias("Extra"), F.format_string("%.4f", "p_retailprice").alias("Abundance"), F.col("p_type").alias("Contig_name"), F.col("p_partkey").alias("Genome"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.col("Genome").cast("long").alias("genome"), F.col("Contig_name").alias("contig"), F.col("Abundance").cast("double").alias("abundance"))


@query("catalog_normalise", "SELECT r_name AS grp, lower(n_name) AS biome, CAST(count(s_suppkey) AS BIGINT) AS species, count(s_suppkey) > 3 AS available FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def catalog_normalise(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of nations in regions as nested JSON, read by schema; available if it has a URL."""
    suppliers = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nation = I.table(spark, d, "nation").join(suppliers, "n_nationkey", "left").fillna(0, ["n"])
    entry = F.struct(F.lower("n_name").alias("key"), F.col("n").alias("species"), F.when(F.col("n") > 3, F.concat(F.lit("https://db.example/"), "n_name")).alias("url"))
    groups = nation.groupBy("n_regionkey").agg(F.collect_list(entry).alias("biomes")).join(I.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    texts = groups.select(F.to_json(F.struct(F.col("r_name").alias("label"), "biomes")).alias("json"))
    parsed = texts.select(F.from_json("json", "label string, biomes array<struct<key:string,species:bigint,url:string>>").alias("g"))
    rows = parsed.select(F.col("g.label").alias("grp"), F.explode("g.biomes").alias("b"))
    return rows.select("grp", F.col("b.key").alias("biome"), F.col("b.species").alias("species"), F.col("b.url").isNotNull().alias("available"))


_GROUP_LINE = "CASE WHEN c_custkey % 10 = 0 THEN '# ' || c_name ELSE '\"' || 'S' || (c_custkey // 2) || '\"' || CASE c_custkey % 3 WHEN 0 THEN ',' WHEN 1 THEN chr(9) ELSE ';' END || ' ' || c_mktsegment END"


@query("group_csv", f"""WITH l AS (SELECT c_custkey AS n, {_GROUP_LINE} AS line FROM customer), p AS (SELECT n, list_transform(regexp_split_to_array(line, '[,;\\t]'), lambda x: trim(replace(x, '"', ''))) AS l FROM l WHERE NOT starts_with(line, '#'))
SELECT l[1] AS sample, arg_max(l[2], n) AS grp FROM p GROUP BY l[1]""")
def group_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines of "sample, group" with three separators, comments and quotes; the last line on a sample wins."""
    rows = I.table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.expr(_GROUP_LINE.replace("c_custkey // 2", "c_custkey div 2")).alias("line"))
    cells = F.transform(F.split("line", "[,;\t]"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    parsed = rows.filter(~F.col("line").startswith("#")).select("n", cells.alias("l"))
    return parsed.groupBy(F.col("l")[0].alias("sample")).agg(F.max_by(F.col("l")[1], "n").alias("grp"))


@query("list_inputs", "SELECT DISTINCT trim(url) AS path FROM pages WHERE trim(url) <> ''")
def list_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Paths listed one a line, in files written and read back."""
    path = scratch(spark)
    I.table(spark, d, "pages").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''").distinct()


# ---- names of lineages

_LINEAGE = "'d__' || p_type || ';p__;c__;o__;f__' || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'F' || p_size END || ';g__' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END || ';s__' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END"


def _rank_sql(column: str) -> str:
    parts = [f"nullif(trim(regexp_extract({column}, '(?:^|;){p}__([^;]*)', 1)), '') || '{s}'" for p, s in nm.RANK_ENDINGS]
    return f"coalesce({', '.join(parts)}, 'unclassified')"


@query("lineage_name", f"WITH l AS (SELECT p_partkey, {_LINEAGE} AS lineage FROM part) SELECT p_partkey, {_rank_sql('lineage')} AS name FROM l")
def lineage_name(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "part").select("p_partkey", nm.lineage_name(F.expr(_LINEAGE)).alias("name"))


@query("named_species", f"WITH l AS (SELECT p_partkey, {_LINEAGE} AS lineage FROM part), n AS (SELECT p_partkey, {_rank_sql('lineage')} AS name FROM l) SELECT p_partkey, name <> 'unclassified' AND NOT regexp_matches(name, '( sp\\.|\\(family\\)|\\(order\\)|\\(class\\)|\\(phylum\\)|\\(domain only\\))$') AS named FROM n")
def named_species(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.screening import is_named

    return I.table(spark, d, "part").select("p_partkey", is_named(nm.lineage_name(F.expr(_LINEAGE))).alias("named"))


@query("taxon_at_rank", "WITH k AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS key FROM lineitem), t AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand FROM part) SELECT l_orderkey, l_linenumber, p_brand AS taxon FROM k LEFT JOIN t USING (key)")
def taxon_at_rank(spark: SparkSession, d: str) -> DataFrame:
    """Line items' taxa: some are looked up with .gz, some keys of the map have it."""
    from ..operators.screening import without_gz

    gz = F.when(F.col("l_linenumber") % 2 == 0, ".gz").otherwise("")
    items = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", without_gz(F.concat(F.col("l_partkey").cast("string"), gz)).alias("key"))
    map_gz = F.when(F.col("p_size") > 25, ".gz").otherwise("")
    taxa = I.table(spark, d, "part").select(without_gz(F.concat(F.col("p_partkey").cast("string"), map_gz)).alias("key"), F.col("p_brand").alias("taxon"))
    return items.join(taxa, "key", "left").select("l_orderkey", "l_linenumber", "taxon")


@query("archive_bin", "SELECT p_partkey, 'ACCN' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS accession, p_partkey // 100 AS bin FROM part")
def archive_bin(spark: SparkSession, d: str) -> DataFrame:
    acc = F.concat(F.lit("ACCN"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return I.table(spark, d, "part").select("p_partkey", acc.alias("accession"), nm.archive_bin(acc).alias("bin"))


@query("species_reps", "SELECT p_partkey AS genome, p_name AS species FROM part WHERE p_partkey = (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = part.p_name)")
def species_reps(spark: SparkSession, d: str) -> DataFrame:
    """Genomes that are their own species' representative."""
    part = I.table(spark, d, "part").select(F.col("p_partkey").alias("genome"), F.col("p_name").alias("species"))
    reps = part.groupBy("species").agg(F.min("genome").alias("rep"))
    return part.join(reps, "species").filter("genome = rep").select("genome", "species")


@query("unique_name", "WITH n AS (SELECT s_suppkey, 'sample' || s_nationkey AS base, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT s_suppkey, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM n")
def unique_name(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("sample"), F.col("s_nationkey").cast("string"))
    k = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return I.table(spark, d, "supplier").select("s_suppkey", base.alias("base"), k.alias("k")).select("s_suppkey", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "k")).alias("name"))


# ---- bookkeeping

@query("status_rollup", "SELECT o_orderpriority AS batch, count(*) AS samples, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS incomplete FROM orders GROUP BY ALL")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return I.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count(F.lit(1)).alias("samples"), count("F").alias("done"), count("O").alias("open"), count("P").alias("incomplete"))


@query("specimen_check", "SELECT p_type AS scientific_name, count(*) AS n, regexp_matches(p_type, '^(ECONOMY|STANDARD)$') AS fits FROM part GROUP BY ALL")
def specimen_check(spark: SparkSession, d: str) -> DataFrame:
    counts = I.table(spark, d, "part").groupBy(F.col("p_type").alias("scientific_name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fits", F.col("scientific_name").rlike("^(ECONOMY|STANDARD)$"))


@query("manifest_diff", """WITH a AS (SELECT n_regionkey AS part, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL), b AS (SELECT n_regionkey AS part, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 OR n_regionkey < 2 GROUP BY ALL)
SELECT part, n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT part, n, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers counted by region, all of them against those in credit (and all of two regions)."""
    nation = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("part"))
    rows = I.table(spark, d, "supplier").join(nation, "s_nationkey")
    count = lambda x: x.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return rn.manifest_diff(count(rows), count(rows.filter("s_acctbal > 0 or part < 2")))


@query("completeness_gate", "WITH h AS (SELECT o_orderpriority AS batch, count(*) AS wanted, count(l.k) AS have FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey GROUP BY ALL) SELECT batch, wanted, have, have >= 0.99 * wanted AS complete FROM h")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    """Orders that have items, of all orders, by priority; complete from 99 percent."""
    have = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("k", F.lit(1))
    rows = I.table(spark, d, "orders").join(have, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count(F.lit(1)).alias("wanted"), F.count("k").alias("have"))
    return rows.withColumn("complete", F.col("have") >= 0.99 * F.col("wanted"))


# ---- streams

@query("stream_sketch", f"WITH {I.SAMPLE} SELECT sample, h, cnt FROM counts")
def stream_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The sample sketches from a stream of documents: equal to those made at once."""
    from ..functions.kmers import dna

    def occurrences(docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").alias("genome"), F.col("lang").alias("sample"), F.posexplode(F.split("text", r"\.")).alias("contig", "s")).withColumn("s", F.trim("s"))
        rows = rows.withColumns({"seq": dna(F.col("s")), "idx": F.col("genome") * 100000 + F.col("contig")})
        reads = rows.select("sample", "idx", F.substring("seq", (F.col("idx") % 29 + 1).cast("int"), F.lit(100)).alias("seq"))
        return sk.read_kmers(reads, I.K, I.C)

    found = st.drain(st.stream_table(spark, f"{d}/documents.parquet"), occurrences, scratch(spark))
    return sk.sample_sketch(found, cap=4)


@query("stream_fastq", f"WITH {I.SAMPLE} SELECT sample, h, cnt FROM counts")
def stream_fastq(spark: SparkSession, d: str) -> DataFrame:
    """The sample sketches from FASTQ files as a stream of bytes: the same again."""
    path = _written(spark, I.reads(spark, d))
    stream = sq.stream_sequences(spark, path, split_bytes=RANGE)
    found = st.drain(stream, lambda batch: sk.read_kmers(_named(batch.filter("ok")).select("sample", "idx", "seq"), I.K, I.C), scratch(spark))
    return sk.sample_sketch(found, cap=4)


@query("stream_pairs", f"WITH {I.PAIRS} SELECT idx, r1, r2 FROM pairs")
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mates from two streams of turns, joined as they arrive."""
    from ..functions.kmers import dna

    def side(k: int) -> DataFrame:
        turns = st.stream_table(spark, f"{d}/conversations.parquet").filter(F.col("turn") % 2 == k)
        return turns.select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("idx"), dna(F.col("text")).alias(f"r{k + 1}"))

    # Ordinals count a thousand a conversation: mates may be a hundred thousand conversations apart.
    return st.drain(st.joined_mates(side(0), side(1), "idx", 100_000 * 1000), lambda x: x, scratch(spark)).select("idx", "r1", "r2")


@query("stream_mates", f"WITH {I.PAIRS} SELECT idx, r1, r2 FROM pairs")
def stream_mates(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs without ordinals: each conversation is a sample, its even and odd
    turns are sides that arrive as they like and are paired in their order, by state."""
    from ..functions.kmers import dna
    from ..streaming.pairs import paired_stream

    turns = st.stream_table(spark, f"{d}/conversations.parquet")
    sides = turns.select(F.col("conv_id").cast("string").alias("sample"), (F.col("turn") % 2 + 1).cast("int").alias("mate"), F.col("turn").cast("long").alias("at"), dna(F.col("text")).alias("seq"), F.lit(True).alias("ok"))
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)  # the only store that holds state of this kind
    try:
        found = st.drain(paired_stream(sides), lambda x: x, scratch(spark))
    finally:
        spark.conf.set(name, before)
    return found.filter("kind = 'pair'").select((F.col("sample").cast("long") * 1000 + F.col("idx")).alias("idx"), "r1", "r2")
