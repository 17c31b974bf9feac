import gzip
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from kelpwood.sources import sequences as m


class Held:
    """A file in memory with the two calls that the reader makes."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        assert 0 <= at <= len(self.data)
        return self.data[at : at + n]


def blocks(data, size):
    """A block-gzip file with members of ``size`` bytes of data, and the empty one at the end."""
    out = []
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        z = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return out


def scan(data):
    """The records of a file, line by line from the top."""
    text = data.lstrip(b"\r\n")
    lines = [x.removesuffix(b"\r") for x in data.split(b"\n")]
    if not lines[-1]:
        lines.pop()
    out = []
    if text[:1] == b">":
        for x in lines:
            if x[:1] == b">":
                out.append([x[1:].split(b" ")[0].replace(b"\t", b" ").decode("latin-1"), "", None, True])
            elif out:
                out[-1][1] += x.replace(b"\r", b"").decode("latin-1")
        return [tuple(r) for r in out]
    i, before = 0, "covered"
    while i < len(lines):
        four = lines[i : i + 4]
        if len(four) == 4 and four[0][:1] == b"@" and four[1][:1] != b"@" and four[2][:1] == b"+" and len(four[1]) == len(four[3]):
            if before == "blank":
                out.append((None, None, None, False))
            out.append((four[0][1:].split(b" ")[0].replace(b"\t", b" ").decode("latin-1"), four[1].decode("latin-1"), four[3].decode("latin-1"), True))
            i, before = i + 4, "covered"
        else:
            if lines[i] and before != "loose":
                out.append((None, None, None, False))
            i, before = i + 1, "loose" if lines[i] else "blank"
    return out


def in_ranges(data, size):
    out, last = [], -1
    for at in range(0, len(data), size):
        for row in m.range_rows(Held(data), at, min(len(data), at + size)):
            assert row[0] > last
            last = row[0]
            out.append(row[1:])
    return out


LINE = hs.sampled_from(["@a", "@b c", "AC", "ACG", "+", "+x", "II", "III", "@II", "@I", "", "@", "+I", "IIII", "@b\r", "AC\r", "+\r", "@@", "junk"])


@given(hs.lists(LINE, max_size=24), hs.booleans(), hs.integers(1, 40), hs.integers(1, 9), hs.integers(1, 7))
@settings(max_examples=600, deadline=None)
def test_any_lines_in_ranges_of_any_size(lines, ended, size, back, piece):
    data = ("@a\n" + "\n".join(lines) + "\n" * ended).encode()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "BACK", back)
        patch.setattr(m, "PIECE", piece)
        assert in_ranges(data, size) == scan(data)


@given(hs.lists(hs.sampled_from([">a", ">b c", "ACGT", "AC", "", "\r", "@x", ">"]), max_size=20), hs.integers(1, 30), hs.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_fasta_in_ranges_of_any_size(lines, size, piece):
    data = "\n".join([">x", *lines]).encode()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "PIECE", piece)
        assert in_ranges(data, size) == scan(data)


READS = b"".join(b"@r%d x\n%s\n+\n%s\n" % (i, b"ACGT" * (i % 9 + 1), b"@+I!" * (i % 9 + 1)) for i in range(200))


@pytest.mark.parametrize("member", [50, 333, 70_000])
def test_block_gzip_is_cut_between_members(member, monkeypatch):
    monkeypatch.setattr(m, "BACK", 60)
    data = b"".join(blocks(READS, member))
    for size in (1, 7, 100, 5000, 1 << 20) if member > 50 else (100, 5000):
        assert in_ranges(data, size) == scan(READS)
    if member < 1000:
        parts = [len(list(m.range_rows(Held(data), at, at + 2000))) for at in range(0, len(data), 2000)]
        assert sum(parts) == 200 and sum(p > 0 for p in parts) > 1


def test_other_gzip_files_are_one_range():
    data = gzip.compress(READS[:5000]) + gzip.compress(READS[5000:])
    assert in_ranges(data, 300) == scan(READS)
    assert in_ranges(data + b"\0" * 100, 300) == scan(READS)


@pytest.mark.parametrize("kind", ["block", "plain"])
@pytest.mark.parametrize("part", range(6))
@pytest.mark.parametrize("where", ["head", "body", "checksum"])
def test_a_damaged_member_loses_itself_alone(kind, part, where):
    cuts = [i for i in range(len(READS)) if READS[i : i + 2] == b"@r"]
    texts = [READS[a:b] for a, b in zip([*cuts[::34]], [*cuts[34::34], len(READS)])]
    members = [b"".join(blocks(t, 1 << 16)[:1]) if kind == "block" else gzip.compress(t, mtime=0) for t in texts]
    broken = bytearray(members[part])
    at = {"head": 1, "body": len(broken) // 2, "checksum": len(broken) - 6}[where]
    broken[at] ^= 0xFF
    data = b"".join([*members[:part], bytes(broken), *members[part + 1 :]])
    got = in_ranges(data, 1 << 20)
    lost = {r[0] for r in scan(texts[part])}
    names = {r[0] for r in got if r[3]}
    if not (part == 0 and where == "head"):  # without its first bytes the file isn't gzip at all
        assert {r[0] for r in scan(READS)} - names <= lost
        assert any(not r[3] for r in got)
    else:
        assert any(not r[3] for r in got)


def test_a_cut_file_says_so():
    data = gzip.compress(READS)
    got = in_ranges(data[: len(data) // 2], 1 << 20)
    assert 0 < len(got) < 200 and not got[-1][3] and all(r[3] for r in got[:-1])


@pytest.mark.parametrize("BACK", [50, 1 << 16])
def test_a_long_line_isn_t_read_again_by_each_range(monkeypatch, BACK):
    monkeypatch.setattr(m, "PIECE", 100)
    monkeypatch.setattr(m, "BACK", BACK)
    data = b">chr\n" + b"A" * 100_000 + b"\n>other\nC\n"
    read = []
    monkeypatch.setattr(Held, "read_at", lambda self, n, at: (read.append(n), self.data[at : at + n])[1])
    assert len(list(m.range_rows(Held(data), 50_000, 50_500))) == 0 and sum(read) < BACK + 3_000


def test_spark_reads_ranges_as_tasks(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(READS)
    (tmp_path / "b.fq.gz").write_bytes(b"".join(blocks(READS, 500)))
    (tmp_path / "c.fa").write_text(">c1 d\nAC\n\nGT\n>c2\nA")
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "empty.fq").write_text("")
    df = m.read_sequences(spark, str(tmp_path), 1000)
    assert df.rdd.getNumPartitions() >= len(READS) // 1000
    got = {}
    for r in m.numbered(df).orderBy("path", "idx").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.idx, r.name, r.seq, r.qual, r.ok))
    want = [(i, *r) for i, r in enumerate(scan(READS))]
    assert got == {"a.fq": want, "b.fq.gz": want, "c.fa": [(0, "c1", "ACGT", None, True), (1, "c2", "A", None, True)]}
    assert m.read_sequences(spark, str(tmp_path / "a.fq"), 77).count() == 200
    (tmp_path / "none").mkdir()
    assert m.read_sequences(spark, str(tmp_path / "none")).count() == 0


def grown(data, cuts):
    return [row for a, b in zip([0, *cuts], [*cuts, len(data)]) if b > a for row in m.grown_rows(Held(data), a, b, b)]


@given(hs.lists(LINE, max_size=24), hs.lists(hs.integers(0, 120), max_size=8), hs.integers(1, 9), hs.integers(1, 7))
@settings(max_examples=400, deadline=None)
def test_any_cut_of_a_growing_file_gives_the_same_rows(lines, cuts, back, piece):
    data = ("@a\n" + "\n".join(lines)).encode()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "BACK", back)
        patch.setattr(m, "PIECE", piece)
        at_once = grown(data, [])
        assert grown(data, sorted(c for c in cuts if c < len(data))) == at_once
        rows = [r[1:] for r in at_once]
        assert rows == scan(data)[: len(rows)]


def test_a_growing_file_of_whole_records():
    for cuts in ([], [1], list(range(1, 1500)), [10_000, 10_001]):
        assert [r[1:] for r in grown(READS, cuts)] == scan(READS)


@pytest.mark.parametrize("cuts", [[], [50], [5, 60, 61, 150]])
def test_a_record_over_the_cap_rejects_its_file(monkeypatch, cuts):
    monkeypatch.setattr(m, "CARRY_MAX", 100)
    long = b"@a\nAC\n+\nII\n@b\n" + b"A" * 80 + b"\n+\n" + b"I" * 80 + b"\n@c\nA\n+\nI\n"
    assert any(r[0] == -1 for r in grown(long, cuts))
    assert any(r[0] == -1 for r in grown(b"@" + b"A" * 300, cuts))
    assert not any(r[0] == -1 for r in grown(b"@a\nAC\n+\nII\n" * 20, cuts))
    assert [r[0] for r in grown(b">fasta\nAC\n" * 20, cuts)] == [-1]


def test_a_stream_of_growing_files_loses_and_doubles_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    files = {"a.fq": READS, "b.fq": READS[: len(READS) // 2].rsplit(b"@r", 1)[0], "c.fq": b">no fastq\nAC\n"}

    def run(fail=False):
        """Everything there is, in a query that starts from its checkpoint; it may fail between writing and committing."""

        def write(batch, n):
            batch.write.mode("overwrite").parquet(f"{out}/batches/batch={n}")
            if fail:
                raise RuntimeError("lost")

        q = m.stream_sequences(spark, str(folder), 700).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert fail

    for k, share in enumerate((0.013, 0.4, 0.41, 1.0)):
        for name, data in files.items():
            if k or name != "b.fq":
                (folder / name).write_bytes(data[: int(len(data) * share)])
        run(fail=k == 1)
    got = {}
    for r in spark.read.parquet(f"{out}/batches").orderBy("path", "at").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.name, r.seq, r.qual, r.ok))
    assert got == {"a.fq": scan(READS), "b.fq": scan(files["b.fq"]), "c.fq": [(None, None, None, False)]}
