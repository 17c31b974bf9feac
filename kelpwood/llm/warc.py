"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it (WARC-Refers-To), with ids
made from its content, so a rerun makes the same ones. Both keep the target
URI, the date and the payload digest of their source; the metadata record also
keeps the source's HTTP headers, the title and the links.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow

#: Bytes of records that a worker hands on at once, beyond the last of them.
CHUNK_BYTES = 16 << 20

# HTML elements that end a line of text, and named entities that are decoded, the ampersand last.
LINE_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

# Each pattern reads on to the next angle bracket at most, or uses up what it reads, so that no page is read over and
# over: a tag holds no "<", and a comment, script, style or title that isn't closed goes on to the end of the page.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)"
LINE_TAG = rf"(?i)</?(?:{LINE_TAGS})(?:\s[^<>]*)?/?>"
TAG = "<[^<>]*>"
TITLE = r"(?is)<title[^<>]*>(.*?)(?:</title|\z)"
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']([^"'<>]*)["']"""
NUMERIC = "^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"


def plain_text(html: Column) -> Column:
    """Comments, scripts and styles go, tags go, line elements end lines, white
    space is squeezed; the named entities above and numeric ones are decoded."""
    return seen_text(F.regexp_replace(html, UNSEEN, ""))


def seen_text(html: Column) -> Column:
    """plain_text of a page without comments, scripts and styles."""
    text = F.regexp_replace(html, LINE_TAG, "\n")
    text = F.regexp_replace(text, TAG, "")
    for name, char in ENTITIES[:-1]:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.replace(numeric_decoded(text), F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))
    text = F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " ")  # a single space is left alone
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def numeric_decoded(text: Column) -> Column:
    """Decimal and hexadecimal entities as their characters; those of no character stay."""

    def one(x: Column) -> Column:
        whole, hexa, decimal = (F.regexp_extract(x, NUMERIC, k) for k in (0, 1, 2))
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).otherwise(decimal).cast("long")
        valid = (whole != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substring(x, F.length(whole) + 1, F.length(x)))).otherwise(F.concat(F.lit("&#"), x))

    parts = F.split(text, "&#")
    rest = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), "")
    return F.when(F.contains(text, F.lit("&#")), F.concat(parts[0], rest)).otherwise(text)


def urn(*parts: Column) -> Column:
    """A urn:uuid made from a digest of the parts."""
    d = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda at, n: F.substring(d, at, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-a"), cut(16, 3), F.lit("-"), cut(19, 12), F.lit(">"))


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of pages, which has no headers or dates of its own."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url_col, html_col))
    return pages.select(
        F.col(id_col).cast("long").alias("source_id"),
        urn(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, html).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(html).cast("string")).alias("http_header"),
        html.alias("payload"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Responses (source_id, record_id, target_uri, warc_date, http_header,
    payload) to two records each: source_id, warc_type, record_id, refers_to,
    target_uri, warc_date, content_type, content_length, block_digest,
    payload_digest (the source's), block.

    A column payload_digest of the responses, where it isn't null, is the source's
    digest; else it is that of the payload as UTF-8. A column block_digest goes
    into the metadata.

    Defined results: null headers and payloads count as empty, and give records
    with an empty text; other nulls pass through (a null record_id leaves both
    ids null); equal responses give equal records, as often as they occur;
    other columns are dropped; an empty table gives an empty one.
    """
    header, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("http_header", "payload"))
    line = lambda c: F.trim(F.regexp_replace(c, r"[\r\n\t ]+", " "))
    links = F.transform(F.regexp_extract_all("seen", F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), line(x)))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), line(F.regexp_extract("payload", TITLE, 1))),
        F.regexp_replace("http_header", r"(?m)^(?=.)", "source-header: "),
        F.concat(F.lit("source-payload-digest: "), F.col("digest")),
        *([F.concat(F.lit("source-block-digest: "), F.col("block_digest"))] if "block_digest" in responses.columns else []),
        links,
    )
    rows = responses.withColumns({"http_header": header, "payload": html})
    digest = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    digest = F.coalesce("payload_digest", digest) if "payload_digest" in responses.columns else digest
    rows = rows.withColumns({"digest": digest, "seen": F.regexp_replace("payload", UNSEEN, "")})
    kinds = [("metadata", "application/warc-fields", F.concat(fields, F.lit("\r\n"))), ("conversion", "text/plain; charset=UTF-8", seen_text(F.col("seen")))]
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("warc_type"), F.lit(t).alias("content_type"), b.alias("block")) for k, t, b in kinds]))
    rows = rows.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "digest", made.alias("made"))
    return rows.select(
        "source_id",
        F.col("made.warc_type").alias("warc_type"),
        F.when(F.col("refers_to").isNotNull(), urn(F.col("made.warc_type"), F.col("refers_to"))).alias("record_id"),
        "refers_to",
        "target_uri",
        "warc_date",
        F.col("made.content_type").alias("content_type"),
        F.octet_length("made.block").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("made.block", 256)).alias("block_digest"),
        F.col("digest").alias("payload_digest"),
        F.col("made.block").alias("block"),
    )


def record_text(records: DataFrame) -> DataFrame:
    """Each derivative as the text of a WARC record, without the two line ends after it."""
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in names]
    return records.select(F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Derivatives as WARC files, one for each partition: Spark's text writer,
    with the record separator for line ends."""
    record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class WarcRecords:
    """Records of one WARC file's bytes, decompressed piece by piece.

    Iterates over (headers, block, error). A record whose header or length is
    broken is given as an error with the bytes up to the next line that starts
    with WARC/1, where reading goes on. A gzip member that can't be read or is cut
    off is an error, after what was read of it; reading goes on with the next
    place where a member starts.
    """

    PIECE = 1 << 20

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = data, 0, bytearray()
        self.gzip = data[:2] == b"\x1f\x8b"
        self.member, self.start, self.damage = None, 0, None

    def _more(self) -> bool:
        """One more piece in the buffer; False at the end."""
        import zlib

        if self.damage:
            return False  # what is in the buffer comes first
        if self.at >= len(self.data):
            if self.member is not None:
                self.member, self.damage = None, "cut gzip member"
            return False
        piece = self.data[self.at : self.at + self.PIECE]
        if not self.gzip:
            self.buffer += piece
            self.at += len(piece)
            return True
        if self.member is None:
            self.member, self.start = zlib.decompressobj(31), self.at
        try:
            self.buffer += self.member.decompress(piece, self.PIECE * 16)
        except zlib.error:
            following = self.data.find(b"\x1f\x8b\x08", self.start + 1)
            self.at, self.member, self.damage = following if following >= 0 else len(self.data), None, "damaged gzip member"
            return False
        left = self.member.unused_data or self.member.unconsumed_tail
        self.at += len(piece) - len(left)
        if self.member.eof:
            self.member = None
        return True

    def _find(self, what: bytes, start: int) -> int:
        while (k := self.buffer.find(what, start)) < 0:
            start = max(start, len(self.buffer) - len(what) + 1)
            if not self._more():
                return -1
        return k

    def __iter__(self):
        while True:
            while len(self.buffer) < 7 and self._more():
                pass
            if not self.buffer.strip(b"\r\n"):
                if self._more():
                    continue
                if not self.damage:
                    return
                yield {}, b"", self.damage
                self.buffer.clear()
                self.damage = None
                continue
            lead = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:lead]
            while len(self.buffer) < 7 and self._more():
                pass
            end = self._find(b"\r\n\r\n", 0) if self.buffer.startswith(b"WARC/1.") else -1
            headers: dict[str, str] = {}
            if end >= 0:
                lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = headers.get("content-length", "")
            if end >= 0 and length.isascii() and length.isdigit():
                stop = end + 4 + int(length)
                while len(self.buffer) < stop and self._more():
                    pass
                if len(self.buffer) >= stop:
                    yield headers, bytes(self.buffer[end + 4 : stop]), None
                    del self.buffer[:stop]
                    continue
            after = self._find(b"\nWARC/1.", 1)
            cut = after + 1 if after >= 0 else len(self.buffer)
            yield headers, bytes(self.buffer[:cut]), "broken header" if end < 0 or not length.isdigit() else "broken length"
            del self.buffer[:cut]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip): headers (map, names in lower case),
    block (binary), error (null for whole records; see WarcRecords). A file is
    read by one task, from Spark's binaryFile source (2 GB at most, as it is
    stored); it is decompressed and handed on piece by piece."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .warc import WarcRecords

        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["headers", "block", "error"])

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block, error in WarcRecords(content.as_py()):
                    rows.append((list(headers.items()), block, error))
                    size += len(block)
                    if len(rows) == 500 or size > CHUNK_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), parse, "headers map<string,string>, block binary, error string")


def body_bytes(data: bytes, head: str) -> bytes:
    """A response's body as its sender had it: chunks joined, gzip and deflate undone.
    What can't be undone stays as it is."""
    import re
    import zlib

    head = head.lower()
    if re.search(r"(?m)^transfer-encoding:[^\n]*chunked", head):
        out, at = [], 0
        while (m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(data, at)) and int(m[1], 16):
            out.append(data[m.end() : m.end() + int(m[1], 16)])
            at = m.end() + int(m[1], 16)
            at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"
        data = b"".join(out) if out or m else data
    coding = re.search(r"(?m)^content-encoding:[ \t]*([\w-]+)", head)
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding[1] if coding else "", ()):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            pass
    return data


def body_text(data: bytes, head: str) -> str:
    """A body as text: by the header's charset, else by a byte order mark, else UTF-8."""
    import codecs
    import re

    named = re.search(r"(?im)^content-type:[^\n]*charset=[\"']?([\w.:-]+)", head)
    mark = next((n for m, n in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")) if data.startswith(m)), None)
    try:
        # What is called Latin-1 on the web is the Windows set.
        charset = codecs.lookup(named[1]).name if named else mark or "utf-8"
        return data.decode({"iso8859-1": "cp1252", "ascii": "cp1252"}.get(charset, charset), "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def responses_of(records: DataFrame) -> DataFrame:
    """Records as read_warc gives them to the responses that derivatives() takes,
    with the digests that the records have (payload_digest, block_digest; null
    without). Where a record has no payload digest, it is that of the body's bytes as
    they were sent. The payload is the body without its transfer and content
    encodings, as text by its charset."""
    head = F.col("headers")
    wanted = records.filter((head["warc-type"] == "response") & F.col("error").isNull()).select(
        F.xxhash64(head["warc-record-id"]).alias("source_id"), head["warc-record-id"].alias("record_id"), head["warc-target-uri"].alias("target_uri"),
        head["warc-date"].alias("warc_date"), head["warc-payload-digest"].alias("payload_digest"), head["warc-block-digest"].alias("block_digest"), "block",
    )

    def parse(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from .warc import body_bytes, body_text

        for batch in batches:
            heads, payloads, digests = [], [], []
            for data, digest in zip(batch.column(6).to_pylist(), batch.column(4).to_pylist()):
                first, _, body = (data or b"").partition(b"\r\n\r\n")
                heads.append(first.decode("latin-1"))
                digests.append(digest or "sha256:" + hashlib.sha256(body).hexdigest())
                payloads.append(body_text(body_bytes(body, heads[-1]), heads[-1]))
            cols = [*(batch.column(k) for k in range(4)), pa.array(heads), pa.array(payloads), pa.array(digests), batch.column(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["source_id", "record_id", "target_uri", "warc_date", "http_header", "payload", "payload_digest", "block_digest"])

    return map_arrow(wanted, parse, "source_id long, record_id string, target_uri string, warc_date string, http_header string, payload string, payload_digest string, block_digest string")


def oracle() -> str:
    """The query over pages, for DuckDB."""
    q = lambda s: s.replace("'", "''")
    urn_sql = lambda d: f"'<urn:uuid:' || {d}[1:8] || '-' || {d}[9:12] || '-8' || {d}[13:15] || '-a' || {d}[16:18] || '-' || {d}[19:30] || '>'"
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{q(UNSEEN)}', '', 'g'), '{q(LINE_TAG)}', chr(10), 'g'), '{TAG}', '', 'g')"
    for name, char in ENTITIES[:-1]:
        text = f"replace({text}, '{q(name)}', '{q(char)}')"
    code = f"coalesce(try_cast('0x' || nullif(regexp_extract(x, '{NUMERIC}', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(x, '{NUMERIC}', 2), '') AS BIGINT))"
    one = f"CASE WHEN i > 1 AND {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INTEGER)) || x[length(regexp_extract(x, '{NUMERIC}', 0)) + 1:] WHEN i > 1 THEN '&#' || x ELSE x END"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda x, i: {one}), '')"
    text = f"replace({text}, '{ENTITIES[-1][0]}', '{ENTITIES[-1][1]}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    line = lambda x: rf"trim(regexp_replace({x}, '[\r\n\t ]+', ' ', 'g'))"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT *, sha256(concat_ws(chr(10), 'response', coalesce(CAST(page_id AS VARCHAR), ''), url, html)) AS d, sha256(html) AS sha,
         chr(13) || chr(10) AS nl FROM p),
s AS (SELECT *, {urn_sql('d')} AS refers_to FROM r),
m AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || {line(f"regexp_extract(html, '{q(TITLE)}', 1)")} || nl
    || 'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=UTF-8' || nl
    || 'source-header: Content-Length: ' || strlen(html) || nl
    || 'source-payload-digest: sha256:' || sha || nl
    || array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '{q(UNSEEN)}', '', 'g'), '{q(LINK)}', 1), lambda x: 'outlink: ' || {line('x')} || nl), '') AS block
  FROM s
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=UTF-8', {text} FROM s),
n AS (SELECT *, sha256(concat_ws(chr(10), warc_type, refers_to)) AS d2 FROM m)
SELECT page_id, warc_type, {urn_sql('d2')} AS record_id, refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type,
       strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha AS payload_digest, block
FROM n
"""
