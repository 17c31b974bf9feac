"""k-mers of sequences: packing, hashing, sampling and decoding.

Bases are two bits (A 0, C 1, G 2, T and U 3, anything else 0). A k-mer's key is
the smaller of its own code and that of its reverse complement; a hash of the
key decides whether the k-mer is kept, so all data keep the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import map_arrow

_LOW = 4294967295
#: Bases that a worker takes at once.
BLOCK_BASES = 1 << 19
#: k-mers that are hashed at once: the arrays on the way stay in a core's cache.
HASHED = 1 << 15


def threshold(c: int) -> int:
    """Hashes below it are kept. For c of 2 or more it fits a positive bigint."""
    if c < 2:
        raise ValueError("c must be 2 or more")
    return ((1 << 64) - 1) // c


def dna(text: Column, blocks: int = 4) -> Column:
    """A sequence of 32 bases a block made from any text, the same for equal texts."""
    hexes = [F.md5(F.concat(text, F.lit(str(i))).cast("binary")) for i in range(blocks)]
    return F.translate(F.concat(*hexes), "0123456789abcdef", "ACGTACGTACGTACGT")


def _wrap_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64 on halves, since a bigint overflow is an error."""
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def hash_key(key: Column) -> Column:
    """The mix hash of a packed k-mer as a signed bigint, by built-in functions."""
    steps = [
        lambda x: F.bitwise_not(_wrap_add(x, F.shiftleft(x, 21))),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 24)),
        lambda x: _wrap_add(_wrap_add(x, F.shiftleft(x, 3)), F.shiftleft(x, 8)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)),
        lambda x: _wrap_add(_wrap_add(x, F.shiftleft(x, 2)), F.shiftleft(x, 4)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 28)),
        lambda x: _wrap_add(x, F.shiftleft(x, 31)),
    ]
    for step in steps:
        key = _let(key, step)
    return key


def _mixed(key):
    """hash_key on a numpy uint64 array, which wraps by itself."""
    import numpy as np

    u = np.uint64
    key = ~(key + (key << u(21)))
    key ^= key >> u(24)
    key = key * u(265)
    key ^= key >> u(14)
    key = key * u(21)
    key ^= key >> u(28)
    return key + (key << u(31))


def unmixed(h):
    """The keys of hashes, on a numpy uint64 array."""
    import numpy as np

    u = np.uint64
    inverse = lambda m: u(pow(m, -1, 1 << 64))

    def unxor(x, n):
        y = x
        for _ in range(64 // n):
            y = x ^ (y >> u(n))
        return y

    key = h * inverse((1 << 31) + 1)
    key = unxor(key, 28) * inverse(21)
    key = unxor(key, 14) * inverse(265)
    key = ~unxor(key, 24)
    return key * inverse((1 << 21) + 1)


def packed_kmers(codes, k: int):
    """Canonical keys of all windows of an array of base codes (uint64)."""
    import numpy as np

    u = np.uint64

    def join(left, m: int, right, n: int):
        """Windows of m + n bases from those of m and of n: (codes, codes of the reverse complement)."""
        size = max(0, len(codes) - m - n + 1)
        forward = (left[0][:size] << u(2 * n)) | right[0][m : m + size]
        return forward, left[1][:size] | (right[1][m : m + size] << u(2 * m))

    # Windows of 1, 2, 4 and so on bases make those of k.
    power, width, whole, done = (codes, u(3) - codes), 1, None, 0
    while True:
        if k & width:
            whole = power if whole is None else join(whole, done, power, width)
            done += width
        if done == k:
            return np.minimum(*whole)
        power, width = join(power, width, power, width), 2 * width


def base_codes():
    """The two bits of each byte."""
    import numpy as np

    code = np.zeros(256, np.uint64)
    for bases, value in (("Cc", 1), ("Gg", 2), ("TtUu", 3)):
        code[list(bases.encode())] = value
    return code


def column_bytes(column):
    """An Arrow column of strings as its bytes and where each row ends in them, without
    a Python object a row; null rows are empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and data.size else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


def kept_between(data, ends, k: int, limit: int, low: int, high: int):
    """The k-mers that start in [low, high) of data, the bytes of sequences that end at
    ``ends``, and whose hashes are below limit: (sequence, pos in it, h) as arrays."""
    import numpy as np

    table, kept = base_codes(), []
    for at in range(low, max(low + 1, high), HASHED):
        h = _mixed(packed_kmers(table[data[at : min(at + HASHED, high) + k - 1]], k))
        below = np.flatnonzero(h < np.uint64(limit))
        kept.append((below + at, h[below].view(np.int64)))
    found, h = (np.concatenate(x) for x in zip(*kept))
    piece = np.searchsorted(ends, found, "right")
    inside = found + k <= ends[piece]
    found, piece = found[inside], piece[inside]
    return piece, found - np.where(piece, ends[piece - 1], 0), h[inside]


def kept_kmers(pieces: list[bytes], k: int, limit: int):
    """kept_between for all of some pieces of sequences."""
    import numpy as np

    data = np.frombuffer(b"".join(pieces), np.uint8)
    return kept_between(data, np.cumsum([len(t) for t in pieces], dtype=np.int64), k, limit, 0, len(data))


def read_fingerprints(reads, most: int = 400):
    """fingerprints() of single reads, a list or an Arrow column, by numpy, as a pair
    of Arrow columns; null beyond ``most`` bases too."""
    import numpy as np
    import pyarrow as pa

    column = reads if isinstance(reads, pa.Array) else pa.array(reads, pa.string())
    data, ends = column_bytes(column)
    if len(data) and data.max() > 127:
        # One byte a character, whatever it is, so that places are the same as in a column.
        data, ends = column_bytes(pa.array([(t or "").encode("ascii", "replace") for t in column.to_pylist()], pa.binary()))
    lengths = np.diff(ends, prepend=0)
    enough = (lengths >= 66) & (lengths <= most)
    starts, lengths = (ends - lengths)[enough], lengths[enough]
    codes = base_codes()[data]
    out = []
    for odd in (0, 1):
        value = np.zeros(len(starts), np.uint64)
        for first in (starts, starts + lengths // 2):
            for i in range(16):
                value = (value << np.uint64(2)) | codes[first + (odd + 2 * i)]
        whole = np.zeros(len(enough), np.int64)
        whole[enough] = value.view(np.int64)
        out.append(pa.array(whole, mask=~enough))
    return out


def explode_kmers(df: DataFrame, k: int = 21, c: int = 20, seq_col: str = "seq", marks: bool = False, keys: bool = False) -> DataFrame:
    """Rows of df without ``seq_col``, once for each kept k-mer: pos (from 0) and h,
    with ``marks`` the fingerprints fp0 and fp1 of the sequence, as a single read, and
    with ``keys`` the packed k-mer as key, by the inverse hash.

    Sequences shorter than k, and null ones, give no rows. Hashing happens in
    Arrow batches before any shuffle, and only the kept k-mers leave them.
    """
    limit = threshold(c)
    keep = [f for f in df.schema.fields if f.name != seq_col]
    rows = df.select(*[f.name for f in keep], seq_col)
    added = [("pos", T.IntegerType()), ("h", T.LongType())] + ([("fp0", T.LongType()), ("fp1", T.LongType())] if marks else []) + ([("key", T.LongType())] if keys else [])
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from kelpwood.functions.kmers import BLOCK_BASES, column_bytes, kept_between, read_fingerprints, unmixed

        for batch in batches:
            sequences = batch.column(batch.num_columns - 1)
            more = read_fingerprints(sequences) if marks else []
            data, ends = column_bytes(sequences)
            # A block may end inside a long sequence: its k-mers are told by where they start.
            for low in range(0, len(data), BLOCK_BASES):
                row, pos, h = kept_between(data, ends, k, limit, low, min(low + BLOCK_BASES, len(data)))
                at = pa.array(row)
                cols = [col.take(at) for col in batch.columns[:-1]]
                back = [pa.array(unmixed(h.view(np.uint64)).view(np.int64))] if keys else []
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pos.astype(np.int32)), pa.array(h), *(m.take(at) for m in more), *back], names=schema.fieldNames())

    return map_arrow(rows, run, schema)


def decode_kmer(key: Column, k: int) -> Column:
    """The bases of a packed k-mer."""
    digits = [F.shiftrightunsigned(key, 2 * (k - 1 - i)).bitwiseAND(3) + 1 for i in range(k)]
    return F.concat(*[F.substring(F.lit("ACGT"), d.cast("int"), F.lit(1)) for d in digits])


def fingerprints(left: Column, right: Column | None = None) -> tuple[Column, Column]:
    """Two fingerprints of a read or pair, null when too short: the 16 even bases
    from both places, and the 16 odd ones, two bits each in a bigint. A single
    read gives its start and its middle, from 66 bases; a pair the starts of its
    mates, from 33 bases each."""

    def packed(bases: list[Column]) -> Column:
        digits = F.regexp_replace(F.translate(F.concat(*bases), "ACGTUacgtu", "0123301233"), "[^0-3]", "0")
        return F.conv(digits, 4, 10).cast("long")

    if right is None:
        enough, second, shift = F.length(left) >= 66, left, F.floor(F.length(left) / 2).cast("int")
    else:
        enough, second, shift = (F.length(left) >= 33) & (F.length(right) >= 33), right, F.lit(0)
    out = []
    for odd in (0, 1):
        first = [F.substring(left, F.lit(1 + odd + 2 * i), F.lit(1)) for i in range(16)]
        then = [F.substring(second, shift + 1 + odd + 2 * i, F.lit(1)) for i in range(16)]
        out.append(F.when(enough, F.shiftleft(packed(first), 32).bitwiseOR(packed(then))))
    return out[0], out[1]
