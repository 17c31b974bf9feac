"""URL rules, WARC, MPEG audio and SentencePiece."""

import gzip
import hashlib
import random
import re
import zlib

import pytest
from compare import DATA, same_result
from edge import no_documents, odd_documents

from kelpwood.llm import bpe_pieces, mpeg_audio, queries, url_rules, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    same_result(queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name]))


# ---- URL rules

ODD_URLS = ["http://a.EXAMPLE.org/es/x", "http://example.org/en/15?q", "http://example.org", "http://example.org?/es/", "https://myexample.org/es/", "http://x.com/de/#f", "http://com/de/", "http://x.com:80/de/", "no scheme/org/", "", None, "http://ads-track.example.net/en", "http://badads-track.net/", "http://m.Casino-Win.com/fr/", "http://h/doubleclick/a/b.GIF", "http://h/doubleclick/b.gif?x", "http://u@x.org/p", "://org/", "a://b://c.org/", "http://org/\nx", "http://\nx.org/en"]


def slow_judge(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)\Z", url or "")
    host, path, rest = m.groups() if m else ("", "", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    site = []
    for r, v in url_rules.SITE_RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            site.append((-len(r), r, v))
    if site:
        _, r, v = min(site)
        return host, path, r, v
    subject = (host + path + rest).lower()
    for r in rules:
        if r["kind"] == "pattern" and re.search(r["regex"].replace(r"\z", r"\Z").replace("(?s:.*)", r"[\s\S]*"), subject):
            return host, path, None, r["verdict"]
    return host, path, None, "allow"


def test_odd_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string, verdict string, host string")
    rules = url_rules.query_rules()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: slow_judge(u, rules) for i, u in enumerate(ODD_URLS * 2)}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize(("rule", "tokens"), [("||ads.example^", ["ads", "example"]), ("*bann*", ["~ban", "~ann"]), ("/pop/*.gif|", ["pop", "gif"]), ("|http", ["~htt", "~ttp"]), ("*ab*", []), ("foo/bar^baz", ["bar"])])
def test_only_whole_tokens_index_a_rule(rule, tokens):
    assert url_rules.pattern_rule(rule, "block")["tokens"] == tokens


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],)], "tokens array<string>")
    rules = [url_rules.pattern_rule("/a/b/c/", "block"), url_rules.pattern_rule("*x*", "block"), url_rules.pattern_rule("/a/zz/", "block")]
    assert {r.rule_no: r.token for r in url_rules.index_rules(urls, rules).collect()} == {0: "b", 1: None, 2: "zz"}


def test_thousands_of_rules_equal_all_rules_on_all_urls(spark, monkeypatch):
    r = random.Random(12)
    words = [f"w{k}" for k in range(120)]
    word = lambda: r.choice(words)
    urls = [f"http://{word()}.{word()}.{r.choice(['com', 'org'])}/{word()}/{word()}{r.choice(['.gif', '?q=' + word(), '', '#' + word()])}" for _ in range(400)]
    made = set()
    while len(made) < 3000:
        made.add(r.choice([f"||{word()}.{word()}^", f"/{word()}/*{word()}", f"/{word()}/{word()}|", f"{word()}^q", f"|{word()}.", f"*{word()}*{word()}*"]))
    rules = [url_rules.pattern_rule(p, r.choice(["allow", "block"]), r.randrange(5)) for p in sorted(made)] + [url_rules.site_rule(f"{word()}.com/{word()}", "allow") for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")

    def plain(url):
        subject = url.split("://")[1]
        fits = [(x["kind"] != "site", -x["rank"], x["rule"], k, x) for k, x in enumerate(rules) if re.search(x["regex"].replace(r"\z", r"\Z").replace("(?s:.*)", r"[\s\S]*"), subject)]
        return min(fits)[4] if fits else None

    want = {i: (b["kind"], b["rule"], b["verdict"]) if (b := plain(u)) else (None, None, "allow") for i, u in enumerate(urls)}
    assert sum(w[1] is not None for w in want.values()) > 200
    for bound in (16 << 20, 0):  # broadcast, and joined
        monkeypatch.setattr(url_rules, "BROADCAST_BYTES", bound)
        got = {x.page_id: ("site", x.rule, x.verdict) if x.rule else ("pattern", x.pattern, x.verdict) if x.pattern else (None, None, x.verdict) for x in url_rules.judge_urls(pages, rules).collect()}
        assert got == want


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.org/", 5, "b")], "page_id long, url string, best int, judged_ string")
    assert url_rules.judge_urls(pages, url_rules.query_rules()).first().best == 5


def test_rules_without_tokens_run_everywhere(spark):
    pages = spark.createDataFrame([(1, "http://h/xbannery"), (2, "http://h/other")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, [url_rules.pattern_rule("*banner*", "block")]).collect()}
    assert got == {1: "block", 2: "allow"}


# ---- WARC


def test_records_survive_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T\nx</title><p>One<p>Two &amp; <b>three</b><!-- no --><script>no()</script><a href='/x'>l</a>"), (2, None, None), (None, "http://b/", ""), (1, "http://a/", "é\n日本")], "page_id long, url string, html string")
    made = warc.derivatives(warc.page_responses(pages))
    warc.write_warc(made, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    mine = made.collect()
    assert len(mine) == 8
    assert sorted((r.headers["warc-record-id"], r.headers["warc-refers-to"], r.headers["content-length"], bytes(r.block)) for r in back) == sorted((r.record_id, r.refers_to, str(r.content_length), r.block.encode()) for r in mine)
    for r in mine:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.refers_to != r.record_id
    one = {r.warc_type: r for r in mine if r.source_id == 1 and ("T x" in r.block or "T\nx" in r.block)}
    assert one["conversion"].block == "T\nx\nOne\nTwo & threel"
    assert "title: T x\r\n" in one["metadata"].block and "outlink: /x\r\n" in one["metadata"].block and "source-header: HTTP/1.1 200 OK\r\n" in one["metadata"].block
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


def test_responses_of_files(spark, tmp_path):
    body = "<title>é</title>".encode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"response", b"request1")) + gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    rows = warc.responses_of(warc.read_warc(spark, str(tmp_path))).collect()
    assert [(r.record_id, r.http_header, r.payload) for r in rows] == [("<urn:uuid:1>", "HTTP/1.1 200 OK\r\nServer: x", body.decode())]
    made = warc.derivatives(warc.responses_of(warc.read_warc(spark, str(tmp_path)))).filter("warc_type = 'metadata'").first()
    broken = warc.read_warc(spark, str(tmp_path)).filter("error is not null").collect()
    assert [(r.error, bytes(r.block)) for r in broken] == [("broken length", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")]
    assert made.refers_to == "<urn:uuid:1>" and "source-header: Server: x" in made.block and made.warc_date == "2020-01-01T00:00:00Z"


@pytest.mark.parametrize("packed", [False, True])
def test_records_after_broken_ones_are_read(packed):
    r = random.Random(4)
    good = [b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % n + bytes(r.randrange(97, 123) for _ in range(n)) + b"\r\n\r\n" for n in (0, 5, 100_000, 3_000_000, 7)]
    bad = [b"WARC/1.0\r\nno length\r\n\r\nrest\r\n", b"junk before\r\n"]
    records = [good[0], bad[0], good[1], good[2], bad[1], good[3], good[4]]
    data = b"".join(gzip.compress(x) for x in records) if packed else b"".join(records)
    got = list(warc.WarcRecords(data))
    assert [len(b) for _, b, e in got if e is None] == [0, 5, 100_000, 3_000_000, 7]
    assert [b for _, b, e in got if e] == bad


@pytest.mark.parametrize("part", ["<", "<!--", "<script>", "<script ", "<title", "<a ", "<a href='", "<p ", "&#", "</script ", "< p>"])
def test_hostile_pages_take_linear_time(spark, part):
    """Ten megabytes of one opening."""
    import time

    html = part * (10_000_000 // len(part))
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    start = time.time()
    assert warc.derivatives(warc.page_responses(pages)).select("block_digest").collect()
    assert time.time() - start < 20


def test_numeric_entities(spark):
    html = "&#65;&#x1F600;&#0;&#xD800;&#1114112;&#12;x&amp;#65; &# &#x; &#233;"
    df = spark.createDataFrame([(html,)], "h string").select(warc.numeric_decoded(warc.F.col("h")).alias("t"))
    assert df.first().t == "A😀&#0;&#xD800;&#1114112;\x0cx&amp;#65; &# &#x; é"


# ---- MPEG audio


def test_checksums_of_layers_one_and_two():
    r = random.Random(8)
    for layer, word in ((1, 0xFFFE9000), (1, 0xFFFE9010 | 1 << 6), (2, 0xFFFC8000), (2, 0xFFFCA440), (2, 0xFFFC10C0), (2, 0xFFF48000)):
        h = mpeg_audio.header(word)
        assert h["layer"] == layer and h["protected"]
        frames = []
        for _ in range(4):
            f = bytearray(word.to_bytes(4, "big") + bytes(r.randrange(256) for _ in range(h["size"] - 4)))
            f[4:6] = covered_crc(f[2:4], f[6:], mpeg_audio.guarded_bits(h, bytes(f))).to_bytes(2, "big")
            frames.append(bytes(f).replace(b"\xff", b"\xff"))
        whole = mpeg_audio.parse_stream(b"".join(frames))
        assert (whole["frames"], whole["protected"], whole["bad_checksums"]) == (4, 4, 0)
        hurt = bytearray(frames[1])
        hurt[6] ^= 1
        assert mpeg_audio.parse_stream(frames[0] + bytes(hurt) + frames[2])["bad_checksums"] == 1
    assert mpeg_audio.guarded_bits(mpeg_audio.header(0xFFFE9000), b"") == 256
    assert mpeg_audio.guarded_bits(mpeg_audio.header(0xFFFE9010 | 1 << 6), b"") == 4 * (2 * 8 + 24)
    assert mpeg_audio.guarded_bits(mpeg_audio.header(0xFFFC8000), bytes(200)) == 2 * (11 * 4 + 12 * 3 + 4 * 2)


def covered_crc(head, body, bits):
    """Bit by bit."""
    crc = 0xFFFF
    stream = "".join(f"{b:08b}" for b in head) + "".join(f"{b:08b}" for b in body)[:bits]
    for b in stream:
        crc = (crc << 1) & 0xFFFF ^ (0x8005 if (crc >> 15) ^ int(b) else 0)
    return crc


@pytest.mark.parametrize("n", [1, 64, 921, 922, 923, 5000, 64_000])
def test_features_follow_from_the_layout(n):
    media = mpeg_audio.store_payload(bytes(n))
    tag = 10 + 10 + 1 + len("payload-bytes\0") + len(str(n))
    whole, rest = divmod(n, 922)
    frames = whole + (rest > 0)
    kbit = min((k for k in (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if 3 * k - 38 >= rest and 3 * k > 38)) if rest else 320
    kbits = sorted({320} if not rest else {320, kbit} if whole else {kbit})
    offsets = [tag + 960 + 960 * k for k in range(frames)]
    seek = ",".join(str(offsets[frames * k // 10]) for k in range(10))
    want = f"frames={frames};samples={1152 * frames};hz=48000;kbit={','.join(map(str, kbits))};crc={frames + 1}/{frames + 1};skipped=0;seek={seek}"
    assert mpeg_audio.feature(mpeg_audio.parse_stream(media)) == want


def test_vbri_table():
    media = mpeg_audio.store_payload(bytes(range(256)) * 20)
    parsed = mpeg_audio.parse_stream(media)
    first = bytearray(media[parsed["offsets"][0] - mpeg_audio.FRAME_BYTES : parsed["offsets"][0]])
    first[mpeg_audio.HEAD_BYTES :] = bytes(len(first) - mpeg_audio.HEAD_BYTES)
    body = b"VBRI" + b"\0\1" + bytes(4) + (6720).to_bytes(4, "big") + (6).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + b"".join((n // 2).to_bytes(2, "big") for n in (1920, 1920, 960))
    first[36 : 36 + len(body)] = body
    start = parsed["offsets"][0]
    got = mpeg_audio.parse_stream(bytes(first) + media[start:])
    assert got["vbr"] == {"kind": "vbri", "bytes": 6720, "frames": 6, "frames_per_entry": 2, "toc": [1920, 1920, 960]}
    assert got["frames"] == 6 and got["offsets"][0] == mpeg_audio.FRAME_BYTES



def slow_crc(data):
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = (crc >> 15) ^ (byte >> bit & 1)
            crc = (crc << 1) & 0xFFFF
            if top:
                crc ^= 0x8005
    return crc


@pytest.mark.parametrize("n", [1, 63, 64, 921, 922, 923, 1844, 5000, 100_000])
def test_payloads_come_back(n):
    r = random.Random(n)
    payload = bytes(r.randrange(256) for _ in range(n))
    media = mpeg_audio.store_payload(payload)
    parsed = mpeg_audio.parse_stream(media)
    assert mpeg_audio.read_payload(media, parsed) == payload
    assert parsed["skipped"] == 0 and parsed["bad_checksums"] == 0 and parsed["protected"] == parsed["frames"] + 1
    assert parsed["frames"] == parsed["vbr"]["frames"] == -(-n // mpeg_audio.ROOM) and parsed["samples"] == 1152 * parsed["frames"]
    assert parsed["seconds"] == parsed["samples"] / 48000 and parsed["vbr"]["bytes"] == len(media) - parsed["offsets"][0] + mpeg_audio.FRAME_BYTES
    for o in parsed["offsets"]:
        assert media[o] == 0xFF and slow_crc(media[o + 2 : o + 4] + media[o + 6 : o + 38]) == int.from_bytes(media[o + 4 : o + 6], "big")


def test_resynchronising_tags_and_damage():
    r = random.Random(2)
    media = mpeg_audio.store_payload(bytes(r.randrange(256) for _ in range(6000)))
    whole = mpeg_audio.parse_stream(media)
    cut = whole["offsets"][2]
    junk = bytes(r.randrange(256) for _ in range(500))
    hurt = mpeg_audio.parse_stream(media[:cut] + junk + media[cut:])
    assert hurt["frames"] == whole["frames"] and hurt["skipped"] == 500 and hurt["offsets"][2] == cut + 500
    broken = bytearray(media)
    broken[cut + 9] ^= 4
    assert mpeg_audio.parse_stream(bytes(broken))["bad_checksums"] == 1
    tagged = mpeg_audio.parse_stream(media + b"TAG" + b"A title".ljust(30, b"\0") + b"\0" * 95)
    assert tagged["tags"]["TIT2"] == "A title" and tagged["skipped"] == 0
    assert mpeg_audio.parse_stream(media[: cut + 100])["skipped"] == 100
    for nothing in (b"", b"\xff", b"\xff\xfb\x90\x00", bytes(3000), b"ID3"):
        assert mpeg_audio.parse_stream(nothing)["frames"] == 0


@pytest.mark.parametrize(("word", "size", "samples"), [(0xFFFB9064, 417, 1152), (0xFFF3A0C4, 313, 576), (0xFFFD9004, 522, 1152), (0xFFFF9004, 312, 384)])
def test_headers(word, size, samples):
    h = mpeg_audio.header(word)
    assert (h["size"], h["samples"]) == (size, samples)


def test_media_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = mpeg_audio.text_media(docs, with_media=True)
    rows = got.collect()
    want = []
    for r in docs.collect():
        p = mpeg_audio.padded(r.text or "")
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        assert len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256
    parsed = mpeg_audio.audio_columns(got, "media", ["doc_id"])
    assert all(r.bad_checksums == 0 and r.frames == len(r.frame_offsets) for r in parsed.collect())
    assert mpeg_audio.text_media(no_documents(spark)).count() == 0


# ---- SentencePiece

PIECES = queries.tokenizer("piece_bpe_32k.model")


def test_agenda_equals_the_library():
    codec = bpe_pieces.PieceCodec(PIECES)
    r = random.Random(1)
    texts = ["", " ", "   ", "a\x00b", "▁a", "  a", "\n", "日本𠮷", "x" + "▁" * 21 + " y", "<s> </s> <unk> <0x0A>", "👩‍👩‍👧", "a" * 300, "ab" * 200, " " * 100, "日" * 50]
    texts += ["".join(r.choice("abcdetion ▁  éß日\n𠮷\x00.,12ZQ") for _ in range(r.randint(0, 120))) for _ in range(1500)]
    for text, (n, ids, decoded) in zip(texts, codec.summaries(texts)):
        want = codec.library.encode(text)
        assert codec.encode(text) == want and ids == ",".join(map(str, want)).encode() and n == len(want)
        assert codec.decode(want) == codec.library.decode(want) == decoded.decode()


@pytest.mark.parametrize("word", ["▁wonderful", "▁" + "abc" * 40, "▁" * 64, "▁ototototot"])
def test_both_agendas_agree(word):
    codec = bpe_pieces.PieceCodec(PIECES)
    assert codec._short(word) == codec._long(word)


def test_pieces_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = bpe_pieces.encode_pieces(docs, PIECES, with_ids=True, check_every=1).collect()
    assert len(got) == docs.count() and all(len(r.ids) == r.n_tokens for r in got)
    empty = [r for r in got if r.doc_id in (3, 4)]
    assert all(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    assert bpe_pieces.encode_pieces(no_documents(spark), PIECES).count() == 0


def warc_record(i, body=b"", head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html", extra=b""):
    block = head + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, extra, len(block), block)


@pytest.mark.parametrize("part", range(6))
@pytest.mark.parametrize("where", ["head", "body", "checksum", "cut"])
def test_a_damaged_warc_member_loses_itself_alone(part, where):
    import gzip

    texts = [bytes(random.Random(k).choices(range(32, 127), k=4000)) for k in range(6)]
    members = [gzip.compress(warc_record(k, t), mtime=0) for k, t in enumerate(texts)]
    broken = bytearray(members[part])
    at = {"head": 2, "body": len(broken) // 2, "checksum": len(broken) - 6, "cut": 0}[where]
    if where == "cut":
        del broken[len(broken) // 2 :]
    else:
        broken[at] ^= 0xFF
    members[part] = bytes(broken)
    found = list(warc.WarcRecords(b"".join(members)))
    whole = {h["warc-record-id"] for h, _, error in found if error is None}
    assert {f"<urn:r:{k}>" for k in range(6)} - whole <= {f"<urn:r:{part}>"}
    assert any(e and "gzip member" in e for _, _, e in found)


def test_source_digests_charsets_and_encodings(spark, tmp_path):
    import gzip
    import hashlib
    import zlib

    kinds = {
        1: (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", "<p>caf\u00e9".encode("latin-1"), b"WARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\n"),
        2: (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip", gzip.compress("<p>na\u00efve".encode()), b""),
        3: (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"4\r\n<p>a\r\n3;x=1\r\nbcd\r\n0\r\n\r\n", b""),
        4: (b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\nTransfer-Encoding: chunked", b"%x\r\n%s\r\n0\r\n\r\n" % (len(zlib.compress(b"<p>z")), zlib.compress(b"<p>z")), b""),
        5: (b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=nowhere", b"<p>plain", b""),
    }
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc_record(i, b, h, x)) for i, (h, b, x) in kinds.items()))
    responses = warc.responses_of(warc.read_warc(spark, str(tmp_path)))
    got = {int(r.record_id[7:-1]): r for r in responses.collect()}
    assert {i: r.payload for i, r in got.items()} == {1: "<p>caf\u00e9", 2: "<p>na\u00efve", 3: "<p>abcd", 4: "<p>z", 5: "<p>plain"}
    assert got[1].payload_digest == "sha1:ABC" and got[2].payload_digest == "sha256:" + hashlib.sha256(kinds[2][1]).hexdigest()
    made = {(int(r.refers_to[7:-1]), r.warc_type): r for r in warc.derivatives(responses).collect()}
    assert made[1, "metadata"].payload_digest == "sha1:ABC" and "source-block-digest: sha1:DEF" in made[1, "metadata"].block
    assert "source-block-digest" not in made[2, "metadata"].block and made[2, "conversion"].block == "na\u00efve"
