"""FASTA and FASTQ files in byte ranges: a data source whose tasks share a file.

What a record is depends on few lines around it, so a range finds its records
wherever it starts. In FASTQ a line starts a record if it begins with @, the next
one doesn't, the one after that begins with +, and the fourth is as long as the
second. The only line inside a record for which all that can hold too is its
fourth; then the earlier of both counts. So a line is a start if the rule holds
and the line three before it is no start, which is what a scan from the top
finds. A range reads back as far as that takes.

Lines with text that belong to no record are a row that is not ok, one for each
run of them, be they broken records or no FASTQ at all; so are blank lines before
a record. Blank lines at the end are nothing. In FASTA a record is a > line and
all up to the next, and blank lines don't matter.

The same files are a stream while they grow. An offset is the bytes of each file
that have been seen, and a record belongs to the batch in which its last line
end comes. What is unfinished is read again with the next batch: it is all that
is carried. If four lines are longer than a limit, or a file doesn't start with @,
the file is rejected by a row that is not ok at -1.

Plain files are cut anywhere. Block-gzip files are cut between their members,
whose sizes are in their headers; other gzip files are one range each. Each is
read, decompressed and handed on piece by piece. A member that can't be read is a
line of its own that fits no record, and reading goes on behind it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import ship

SCHEMA = "path string, split int, place long, at long, name string, seq string, qual string, ok boolean"
#: Bytes of a range, of a piece that is read at once, and read back at first.
SPLIT_BYTES, PIECE, BACK = 128 << 20, 4 << 20, 1 << 16
#: Records and bases of a batch that is handed on, at most (or one record).
BATCH_RECORDS, BATCH_BYTES = 5_000, 16 << 20
#: How a member of a block-gzip file starts: deflate with an extra field.
MEMBER = b"\x1f\x8b\x08\x04"


#: Stands for bytes that can't be decompressed.
DAMAGED = b"\n\0\n"


#: Bytes of an unfinished record that a stream carries at most.
CARRY_MAX = 8 << 20


class FurtherBack(Exception):
    """What lies before the range doesn't tell where its records start."""


class Pieces:
    """The bytes of a range and beyond, from a place before it.

    ``begin`` and ``end`` are where the range starts and ends among the bytes
    handed out so far, None while that isn't known. exact is True if the bytes
    start at the top of the file.
    """

    def __init__(self, file, first: int, last: int, back: int):
        self.file, self.size = file, file.size()
        self.exact = first - back <= 0
        self.at = max(0, first - back)
        self.begin, self.end = first - self.at, last - self.at
        self.top = self.at

    def where(self, place: int) -> int:
        return self.top + place

    def read(self) -> bytes:
        data = self.file.read_at(min(PIECE, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(data)
        return data


class Unpacked:
    """The same of a whole gzip file, of one member or several."""

    exact, begin, end = True, 0, float("inf")

    def __init__(self, file):
        self.file, self.size, self.at = file, file.size(), 0
        self.member, self.left = zlib.decompressobj(31), b""

    def where(self, place: int) -> int:
        return place

    def read(self) -> bytes:
        while True:
            data, self.left = self.left or self._next(), b""
            if not data:
                cut, self.member = self.member is not None, None
                return DAMAGED if cut else b""
            if self.member is None:
                data = data.lstrip(b"\0")
                self.member = zlib.decompressobj(31) if data else None
                if not data:
                    continue
            try:
                out = self.member.decompress(data, PIECE)
            except zlib.error:
                # On from the next place where a member may start.
                self.member, k = None, data.find(MEMBER[:3], 1)
                while k < 0:
                    tail, more = data[-2:], self._next()
                    if not more:
                        return DAMAGED
                    data = tail + more
                    k = data.find(MEMBER[:3], 0 if len(data) > 2 else 1)
                self.left = data[k:]
                return DAMAGED
            self.left = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if out:
                return out

    def _next(self) -> bytes:
        data = self.file.read_at(min(PIECE // 8, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(data)
        return data


class Members:
    """The same of a range of a block-gzip file: the members that start in it, and what follows."""

    def __init__(self, file, first: int, last: int, back: int):
        self.file, self.size, self.first, self.last = file, file.size(), first, last
        self.at = find_member(file, first - back) if first > back else 0
        self.exact = self.at == 0
        self.begin = self.end = None
        self.handed, self.starts = 0, []
        if self.at >= first and not self.exact:
            raise FurtherBack

    def where(self, place: int) -> int:
        import bisect

        k = bisect.bisect_right(self.starts, place, key=lambda s: s[0]) - 1
        return (self.starts[k][1] << 16) + place - self.starts[k][0]

    def read(self) -> bytes:
        out, size = [], 0
        while self.at < self.size and size < PIECE:
            if self.begin is None and self.at >= self.first:
                self.begin = self.handed + size
            if self.end is None and self.at >= self.last:
                self.end = self.handed + size
            length = member_size(self.file, self.at)
            try:
                data = zlib.decompress(self.file.read_at(min(length, self.size - self.at), self.at), 31) if length else DAMAGED
            except zlib.error:
                data = DAMAGED
            length = length if data is not DAMAGED else find_member(self.file, self.at + 1) - self.at
            if data:
                self.starts.append((self.handed + size, self.at))
            out.append(data)
            size += len(data)
            self.at += length
        if self.at >= self.size:
            self.begin = self.handed + size if self.begin is None else self.begin
            self.end = self.handed + size if self.end is None else self.end
        self.handed += size
        return b"".join(out)


def member_size(file, at: int) -> int:
    """Bytes of the block-gzip member at ``at``, 0 if there is none."""
    head = file.read_at(min(18, file.size() - at), at)
    if len(head) < 18 or head[:4] != MEMBER:
        return 0
    extra = file.read_at(min(struct.unpack_from("<H", head, 10)[0], file.size() - at - 12), at + 12)
    while len(extra) >= 4:
        size = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"BC" and size == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + size :]
    return 0


def find_member(file, at: int) -> int:
    """The first place from ``at`` on where a member starts: one that another follows, or that can be read."""
    size = file.size()

    def sound(at: int, length: int) -> bool:
        if member_size(file, at + length):
            return True
        try:
            return zlib.decompress(file.read_at(length, at), 31) is not None
        except zlib.error:
            return False

    while at < size:
        data = file.read_at(min(PIECE, size - at), at)
        k = data.find(MEMBER)
        while k >= 0:
            length = member_size(file, at + k)
            if length and at + k + length <= size and sound(at + k, length):
                return at + k
            k = data.find(MEMBER, k + 1)
        at += max(1, len(data) - 3)
    return size


def opened(file, first: int, last: int, back: int):
    """The bytes of a range, or None if another range has them all."""
    if file.read_at(min(2, file.size()), 0) != b"\x1f\x8b":
        return Pieces(file, first, last, back)
    if member_size(file, 0):
        return Members(file, first, last, back)
    return Unpacked(file) if first == 0 else None


def line_table(data: bytes, whole: bool):
    """Starts and ends (without line ends) of the complete lines of data, and the
    start of what is left; with ``whole`` the rest is a line too."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], stops + 1])
    if whole and starts[-1] < len(data):
        stops, starts = np.append(stops, len(data)), np.append(starts, len(data))
    rest = int(starts[-1])
    starts, ends = starts[:-1], stops
    return raw, starts, ends - ((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 13)), rest


def rule_holds(raw, starts, ends):
    """For each line whether the rule of a record's start holds for it and the three behind it."""
    import numpy as np

    n = len(starts)
    holds = np.zeros(n, bool)
    if n > 3:
        first = np.where(ends > starts, raw[np.minimum(starts, len(raw) - 1)], 0)
        length = ends - starts
        holds[:-3] = (first[:-3] == 64) & (first[1:-2] != 64) & (first[2:-1] == 43) & (length[1:-2] == length[3:])
    return holds


class Lines:
    """The lines of a range and around it, a table at a time, with what FASTQ says of them."""

    def __init__(self, pieces):
        self.pieces, self.data, self.base = pieces, b"", 0
        #: Of the four lines before: are they starts? None: nothing before them is known.
        self.flags: list[bool | None] = [False if pieces.exact else None] * 4
        self.more = True

    def skip_partial(self) -> bool:
        """Leave out the rest of a line that starts before the bytes do; False if no line starts in the range."""
        while self.more and (cut := self.data.find(b"\n")) < 0:
            self.base += len(self.data)
            if self.pieces.end is not None and self.base >= self.pieces.end:
                return False
            self.data = self.pieces.read()
            self.more = bool(self.data)
        if self.more:
            self.data, self.base = self.data[cut + 1 :], self.base + cut + 1
        return self.more

    def tables(self, ahead: int, whole: bool = True) -> Iterator[tuple]:
        """(data, raw, starts, ends, ready) with ``ready`` lines, behind which ``ahead``
        more are in the table, but for the end of the file if it is whole."""
        last = not self.more
        while True:
            found, size = [self.data], len(self.data)
            while not last:
                found.append(self.pieces.read())
                size += len(found[-1])
                last = not found[-1]
                if b"\n" in found[-1]:
                    break
                begin, end = self.pieces.begin, self.pieces.end
                if whole and end is not None and self.base < begin and self.base + size >= end and not any(b"\n" in x for x in found):
                    return  # a line from before the range goes on behind it
            self.data = b"".join(found)
            raw, starts, ends, rest = line_table(self.data, last and whole)
            ready = len(starts) if last and whole else max(0, len(starts) - ahead)
            if ready:
                yield self.data, raw, starts, ends, ready
                cut = int(starts[ready]) if ready < len(starts) else rest
                self.data, self.base = self.data[cut:], self.base + cut
            if last:
                return

    def marked(self, raw, starts, ends, first: int, ready: int):
        """For each ready line whether it is a start, and for it and the line before
        whether a record covers it. From line ``first`` on that must be sure."""
        import numpy as np

        holds = rule_holds(raw, starts, ends)[:ready]
        flags = [*self.flags, *holds.tolist()]
        for j in np.flatnonzero(holds).tolist():
            before = flags[j + 1]
            flags[j + 4] = None if before is None else not before
        if first < ready and None in flags[first : first + 4]:
            raise FurtherBack
        is_start = np.array([x is True for x in flags])
        covered = is_start[3:] | is_start[2:-1] | is_start[1:-2] | is_start[:-3]
        self.flags = flags[-4:]
        return is_start[4:], covered[1:], covered[:-1]


def fastq_rows(pieces, growing: bool = False) -> Iterator[tuple]:
    """(at, name, seq, qual, ok) of the records and runs of other lines that start in
    the range; of a growing file, those that can be told from the bytes of the range
    and not from those before it, which takes three more lines."""
    import numpy as np

    lines = Lines(pieces)
    sure = pieces.exact
    if not sure and not lines.skip_partial():
        if growing:
            raise FurtherBack
        return
    blank_before = False
    for data, raw, starts, ends, ready in lines.tables(3, not growing):
        at = starts[:ready] + lines.base
        begin, end = (float("inf") if x is None else x for x in (pieces.begin, pieces.end))
        # Where a line can be told: at its start, or at the end of the third one behind it.
        told = at if not growing else np.append(starts[4:], lines.base)[:ready] + lines.base - 1
        if growing:
            told[-1] = lines.base + (starts[ready + 3] if ready + 3 < len(starts) else ends_after(raw, starts)) - 1
        is_start, covered, covered_before = lines.marked(raw, starts, ends, int(np.searchsorted(told, begin)), ready)
        blank = ends[:ready] == starts[:ready]
        was_blank = np.concatenate([[blank_before], blank[:-1]])
        gap = is_start & was_blank & ~covered_before
        loose = ~covered & ~blank & (covered_before | was_blank | (at == 0) & (pieces.where(0) == 0))
        mine = (told >= begin) & (told < end)
        if growing and (told - at > CARRY_MAX)[mine].any():
            yield -1, None, None, None, False
        picked = np.flatnonzero(mine & (is_start | loose))
        # Of the name, the bases and the qualities: from where to where.
        spans = [x[np.minimum(picked + k, len(starts) - 1)].tolist() for k in (0, 1, 3) for x in (starts, ends)]
        for place, record, behind, a, b, c, d, e, f in zip(at[picked].tolist(), is_start[picked].tolist(), gap[picked].tolist(), *spans):
            place = pieces.where(place)
            if not record:
                yield place, None, None, None, False
                continue
            if behind:
                yield place - 1, None, None, None, False
            name = data[a + 1 : b].decode("latin-1").split(" ", 1)[0].replace("\t", " ")
            yield place, name, data[c:d].decode("latin-1"), data[e:f].decode("latin-1"), True
        blank_before, sure = bool(blank[-1]), True
        if told[-1] >= end:
            return
    if growing and not sure:
        raise FurtherBack  # a line from before may be told by now


def ends_after(raw, starts) -> int:
    """Where the line behind the last complete one starts."""
    import numpy as np

    return int(starts[-1]) + int(np.flatnonzero(raw[starts[-1] :] == 10)[0]) + 1


def fasta_rows(pieces) -> Iterator[tuple]:
    """(at, name, seq, null, ok) of the records whose > line starts in the range."""
    import numpy as np

    lines = Lines(pieces)
    if not pieces.exact and not lines.skip_partial():
        return
    name, place, parts = None, 0, []

    def record() -> tuple:
        seq = b"".join(parts).translate(None, b"\r\n")
        return place, name, seq.decode("latin-1"), None, b"\0" not in seq

    for data, raw, starts, ends, ready in lines.tables(0):
        at = starts[:ready] + lines.base
        begin, end = (float("inf") if x is None else x for x in (pieces.begin, pieces.end))
        heads = np.flatnonzero((raw[np.minimum(starts[:ready], len(raw) - 1)] == 62) & (ends[:ready] > starts[:ready])).tolist()
        stop = int(ends[ready - 1])
        if name is not None:
            parts.append(data[: starts[heads[0]] if heads else stop])
        for j, then in zip(heads, [*heads[1:], None]):
            if name is not None:
                yield record()
                name = None
            if at[j] >= end:
                return
            if at[j] >= begin:
                name, place = data[starts[j] + 1 : ends[j]].decode("latin-1").split(" ", 1)[0].replace("\t", " "), pieces.where(int(at[j]))
                parts = [data[ends[j] : starts[then] if then is not None else stop]]
        if name is None and at[-1] >= end:
            return
    if name is not None:
        yield record()


def file_format(file) -> str:
    """@, > or another first character of a file's text, or nothing."""
    pieces = opened(file, 0, 1, 0)
    while data := pieces.read():
        if text := data.lstrip(b"\r\n"):
            return text[:1].decode("latin-1")
    return ""


def range_rows(file, first: int, last: int) -> Iterator[tuple]:
    """(at, name, seq, qual, ok) of one range of a file."""
    rows = fasta_rows if file_format(file) == ">" else fastq_rows
    back = BACK
    while True:
        try:
            pieces = opened(file, first, last, back)
            if pieces is not None:
                yield from rows(pieces)
            return
        except FurtherBack:
            back *= 8


class Seen:
    """The part of a file that a stream has seen."""

    def __init__(self, file, size: int):
        self.read_at, self.seen = file.read_at, size

    def size(self) -> int:
        return self.seen


def grown_rows(file, first: int, last: int, seen: int) -> Iterator[tuple]:
    """(at, name, seq, qual, ok) of what the bytes first to last of a growing plain
    FASTQ file tell, of which ``seen`` bytes are there."""
    file = Seen(file, seen)
    if file.read_at(min(1, seen), 0) not in (b"@", b""):
        if first == 0:
            yield -1, None, None, None, False
        return
    if unfinished(file, last) > CARRY_MAX:
        yield -1, None, None, None, False
        return
    back = BACK
    while True:
        try:
            yield from fastq_rows(Pieces(file, first, last, back), growing=True)
            return
        except FurtherBack:
            back *= 8


def unfinished(file, end: int) -> int:
    """Bytes behind the fourth line end from behind before ``end``, or all of them:
    what a stream that is there must carry, and at most three lines more."""
    size = 1 << 12
    while True:
        data = file.read_at(min(size, end), end - min(size, end))
        at = len(data)
        for _ in range(4):
            at = data.rfind(b"\n", 0, max(at, 0))
            if at < 0:
                break
        if at >= 0 or size >= end or size > CARRY_MAX:
            return len(data) - max(at, 0)
        size *= 8


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder that aren't hidden."""
    import glob

    from pyarrow import fs

    out = []
    for one in sorted(glob.glob(path)) if "://" not in path and glob.has_magic(path) else [path]:
        store, inner = fs.FileSystem.from_uri(one)
        info = store.get_file_info(inner)
        found = [info] if info.type != fs.FileType.Directory else store.get_file_info(fs.FileSelector(inner, recursive=True))
        for f in found:
            if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p):
                out.append((one if f.path == inner else one.rstrip("/") + f.path[len(inner.rstrip("/")) :], f.size))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
    return sorted(out)


def _source():
    """The data source; its classes travel by value, and import this module where they run."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    class Range(InputPartition):
        def __init__(self, path: str, split: int, first: int, last: int):
            self.path, self.split, self.first, self.last = path, split, first, last

    class SequenceReader(DataSourceReader):
        def __init__(self, options: dict):
            from kelpwood.sources.sequences import SPLIT_BYTES

            self.path, self.size = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

        def partitions(self):
            from kelpwood.sources.sequences import _listed

            return [Range(path, k, at, min(size, at + self.size)) for path, size in _listed(self.path) for k, at in enumerate(range(0, size, self.size))] or [Range("", 0, 0, 0)]

        def read(self, part):
            from kelpwood.sources.sequences import batches_of

            if part.path:
                yield from batches_of(part.path, part.split, part.first, part.last)

    class SequenceStream(DataSourceStreamReader):
        def __init__(self, options: dict):
            from kelpwood.sources.sequences import SPLIT_BYTES

            self.path, self.size = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

        def initialOffset(self):
            return {}

        def latestOffset(self):
            from kelpwood.sources.sequences import _listed

            return dict(_listed(self.path))

        def partitions(self, start: dict, end: dict):
            grown = [(path, start.get(path, 0), size) for path, size in sorted(end.items()) if size > start.get(path, 0)]
            return [Range(path, seen, at, min(seen, at + self.size)) for path, old, seen in grown for at in range(old, seen, self.size)]

        def read(self, part):
            from kelpwood.sources.sequences import batches_of

            yield from batches_of(part.path, 0, part.first, part.last, part.split)

    class SequenceSource(DataSource):
        @classmethod
        def name(cls):
            return "sequences"

        def schema(self):
            from kelpwood.sources.sequences import SCHEMA

            return SCHEMA

        def reader(self, schema):
            return SequenceReader(self.options)

        def streamReader(self, schema):
            return SequenceStream(self.options)

    return SequenceSource


def batches_of(path: str, split: int, first: int, last: int, seen: int | None = None) -> Iterator:
    """Record batches of SCHEMA for a range of a file in any store that pyarrow reads."""
    import pyarrow as pa
    from pyarrow import fs

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    store, inner = fs.FileSystem.from_uri(path)
    held, size, count = [], 0, 0

    def batch():
        cols = [[path] * len(held), [split] * len(held), range(count - len(held), count), *zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    with store.open_input_file(inner) as file:
        for row in range_rows(file, first, last) if seen is None else grown_rows(file, first, last, seen):
            held.append(row)
            count += 1
            size += len(row[2] or "")
            if len(held) >= BATCH_RECORDS or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def read_sequences(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """FASTA and FASTQ files, plain or gzip: a file, a folder or a pattern. Columns:
    path, split (number of the range), place (of the record in it), at (grows along
    a file), name, seq, qual (null in FASTA), ok. Lines that make no record are a
    row that is not ok, without name or bases. An empty folder gives an empty table."""
    ship(spark)
    spark.dataSource.register(_source())
    return spark.read.format("sequences").option("splitBytes", split_bytes).load(path)


def stream_sequences(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Plain FASTQ files as a stream while they grow and come: the columns of
    read_sequences, of which split and place tell nothing. The last record of a file
    comes with its last line end. A file that doesn't start with @, or has four lines
    of more than CARRY_MAX bytes, has a row that is not ok at -1."""
    ship(spark)
    spark.dataSource.register(_source())
    return spark.readStream.format("sequences").option("splitBytes", split_bytes).load(path)


def numbered(records: DataFrame) -> DataFrame:
    """Records of read_sequences with idx, their number in the file: the records of
    the ranges before, which are counted, and the place in the range."""
    counts = records.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "split", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return records.join(counts, ["path", "split"]).withColumn("idx", F.col("before_") + F.col("place")).drop("before_")
