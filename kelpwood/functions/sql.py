"""The engine's functions for plain SQL: register them once, use them in spark.sql.

All are SQL functions of the session, which the optimizer inlines: nothing runs in
Python. k-mers have 31 bases at most.

    kmers(seq, k)            table function: pos (from 0), kmer
    kmer_key(kmer)           the packed canonical k-mer
    kmer_blocks(seq, k)      array of structs, each with the digits of n k-mers: for many of them
    block_key(b, i, k)       the packed canonical k-mer i of a block, from 0 to b.n - 1
    kmer_mix(key)            the mix hash of a key
    frac_hash(kmer)          both
    frac_kept(h, c)          whether a hash-sampled sketch keeps it: one in c of all
    containment_stats(contained, n_kmers, k)   struct of share and naive identity
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _mix(key: str) -> str:
    """The mix hash in products that wrap: its steps are those of kmers.hash_key."""
    fold = lambda x, n: f"({x} ^ shiftrightunsigned({x}, {n}))"
    x = fold(f"~({key} * 2097153L)", 24)
    for factor, n in ((265, 14), (21, 28)):
        x = fold(f"({x} * {factor}L)", n)
    return f"{x} * 2147483649L"


def _blocks() -> str:
    """Each sequence is turned into digits once, and 31 digits make a number: 32 - k k-mers."""
    digits = "CASE WHEN length(seq) >= k THEN array(kmer_digits(seq)) END"
    strands = f"transform({digits}, f -> named_struct('f', f, 'r', reverse(translate(f, '0123', '3210'))))"
    n = "least(32 - k, length(s.f) - k + 1 - at)"
    number = lambda text, start: f"CAST(conv(substring({text}, {start} + 1, {n} + k - 1), 4, 10) AS BIGINT)"
    block = f"named_struct('forward', {number('s.f', 'at')}, 'backward', {number('s.r', f'length(s.f) - at - ({n} + k - 1)')}, 'n', {n})"
    return f"flatten(transform({strands}, s -> transform(sequence(0, length(s.f) - k, 32 - k), at -> {block})))"


_BLOCK = "STRUCT<forward: BIGINT, backward: BIGINT, n: INT>"

#: name and arguments, what it returns, and its body; later ones use earlier ones.
FUNCTIONS = [
    ("kmers(seq STRING, k INT)", "TABLE (pos INT, kmer STRING)", "SELECT p, substring(seq, p + 1, k) FROM (SELECT explode(sequence(0, greatest(length(seq) - k, 0))) AS p) WHERE length(seq) >= k"),
    ("kmer_digits(kmer STRING)", "STRING", "regexp_replace(translate(upper(kmer), 'ACGTU', '01233'), '[^0-3]', '0')"),
    ("kmer_key(kmer STRING)", "BIGINT", "least(CAST(conv(kmer_digits(kmer), 4, 10) AS BIGINT), CAST(conv(reverse(translate(kmer_digits(kmer), '0123', '3210')), 4, 10) AS BIGINT))"),
    ("kmer_blocks(seq STRING, k INT)", f"ARRAY<{_BLOCK}>", _blocks()),
    (f"block_key(b {_BLOCK}, i INT, k INT)", "BIGINT", "least(shiftright(b.forward, 2 * (b.n - 1 - i)) & (shiftleft(1L, 2 * k) - 1), shiftright(b.backward, 2 * i) & (shiftleft(1L, 2 * k) - 1))"),
    ("kmer_mix(key BIGINT)", "BIGINT", _mix("key")),
    ("frac_hash(kmer STRING)", "BIGINT", "kmer_mix(kmer_key(kmer))"),
    ("frac_kept(h BIGINT, c INT)", "BOOLEAN", "h >= 0 AND h < 18446744073709551615BD div c"),
    ("containment_stats(contained BIGINT, n_kmers BIGINT, k INT)", "STRUCT<share: DOUBLE, naive_ani: DOUBLE>", "named_struct('share', contained / n_kmers, 'naive_ani', pow(contained / n_kmers, 1.0D / k))"),
]


def register(spark: SparkSession) -> None:
    """Make the functions part of the session. A function keeps the settings under which
    it is made: in these, products of bigints wrap."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        for head, kind, body in FUNCTIONS:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    finally:
        spark.conf.set(name, before)
