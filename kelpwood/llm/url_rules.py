"""URL filters: pattern rules found by their rarest literal token.

A rule is compiled to a regular expression and the literal tokens that every
URL it fits must hold. Tokens are counted over all URLs; each rule is indexed
under its rarest one. A URL's own tokens fetch candidate rules by an equi-join,
and only candidates run their regular expression. Rules without a whole token
are candidates everywhere.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Rules whose texts have no more bytes than this are broadcast; others are joined as Spark sees fit.
BROADCAST_BYTES = 16 << 20

#: Characters of the pieces by which rules without a whole token are indexed.
PIECE = 3

_TOKEN = "[a-z0-9]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _literal(text: str) -> str:
    """Escaped so that Java and RE2 read it alike."""
    return re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", text)


def _pieces(literals: list[str]) -> list[str]:
    """What a rule without a whole token is indexed by: pieces of PIECE characters of
    its literal text, marked so that they are no tokens."""
    runs = [m[0] for x in literals for m in re.finditer(_TOKEN, x)]
    return ["~" + r[i : i + PIECE] for r in runs for i in range(len(r) - PIECE + 1)]


def site_rule(rule: str, verdict: str) -> dict:
    """``host/path``: fits the host and its subdomains where the path starts with
    the rule's. Paths are compared as they are."""
    host, slash, path = rule.partition("/")
    regex = rf"^(?:[^/?#]*\.)?{_literal(host)}{_literal(slash + path)}"
    # The last token may go on in the URL, unless something that is no token follows it.
    tokens = [m[0] for m in re.finditer(_TOKEN, rule.lower()) if m.end() < len(rule) and rule[m.end()].lower() not in string.ascii_lowercase + string.digits]
    return {"rule": rule, "verdict": verdict, "kind": "site", "regex": regex, "tokens": tokens or _pieces([rule.lower()]), "rank": len(rule)}


def pattern_rule(rule: str, verdict: str, rank: int = 0) -> dict:
    """A pattern over ``host/path?query#fragment`` in lower case: ``||`` stands
    for the start of the host or of one of its labels, ``|`` for the start or
    end, ``*`` for any text, ``^`` for a separator or the end."""
    body, at_start, at_end = rule.lower(), "", ""
    if body.startswith("||"):
        at_start, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        at_start, body = "^", body[1:]
    if body.endswith("|"):
        at_end, body = r"\z", body[:-1]
    parts = {"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%\-]|\z)"}
    regex = at_start + "".join(parts.get(c) or _literal(c) for c in body) + at_end
    edge = lambda k, closed: closed if not 0 <= k < len(body) else body[k] != "*"
    tokens = [m[0] for m in re.finditer(_TOKEN, body) if edge(m.start() - 1, bool(at_start)) and edge(m.end(), bool(at_end))]
    return {"rule": rule, "verdict": verdict, "kind": "pattern", "regex": regex, "tokens": tokens or _pieces(re.split(r"[*^]", body)), "rank": rank}


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_rest(url: Column) -> Column:
    """Path, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)\z", 1), F.lit(""))


def rule_bytes(rules: list[dict]) -> int:
    """Bytes of all texts of the rules."""
    return sum(len(x.encode()) for r in rules for x in (r["rule"], r["verdict"], r["kind"], r["regex"], *r["tokens"]))


def index_rules(urls: DataFrame, rules: list[dict]) -> DataFrame:
    """(token, rule_no, ...): each rule under its rarest token over ``urls``
    (column tokens); null for rules without a token."""
    spark = urls.sparkSession
    rows = [(r.get("no", k), r["rule"], r["verdict"], r["kind"], r["regex"], r["rank"], sorted(set(r["tokens"]))) for k, r in enumerate(rules)]
    listed = spark.createDataFrame(rows, "rule_no int, rule string, verdict string, kind string, regex string, rank int, tokens array<string>")
    literals = listed.select("rule_no", F.explode("tokens").alias("token"))
    wanted = literals.select("token").distinct()
    if rule_bytes(rules) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return listed.drop("tokens").join(rarest, "rule_no", "left")


def _blocks(rules: list[dict]) -> list[list[dict]]:
    """Rules in lists of no more than BROADCAST_BYTES each."""
    out: list[list[dict]] = []
    size = BROADCAST_BYTES
    for r in rules:
        size += rule_bytes([r])
        if size > BROADCAST_BYTES:
            out.append([])
            size = rule_bytes([r])
        out[-1].append(r)
    return out


def judge_urls(pages: DataFrame, rules: list[dict], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict and pattern.

    The longest site rule that fits decides (rule is its text; of equally long
    ones the first in alphabetical order). Else the pattern rule of the highest
    rank decides (pattern is its text, ties as before), else ``default``.

    Defined results: a null url, or one without ://, has empty host and path
    and fits no rule that needs a host; empty urls likewise; repeated rows get
    equal verdicts; an empty table gives an empty one; without rules all get
    the default; columns of pages with the names of the new ones are replaced.
    """
    new = ["host", "path", "rule", "verdict", "pattern"]
    url, judged_url, best = (fresh(x, pages.columns) for x in ("url_", "judged_", "best_"))
    marked = pages.withColumn(url, F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    kept = [c for c in pages.columns if c.lower() not in new]
    subject = F.concat(url_host(F.col("url")), url_rest(F.col("url")))
    urls = marked.select(F.col(url).alias("url")).distinct().select("url", subject.alias("subject"))
    urls = urls.withColumn("low", F.translate("subject", _UPPER, _LOWER))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all("low", F.lit(_TOKEN), F.lit(0))))
    rules = [{**r, "no": k} for k, r in enumerate(rules)]
    if any(t[:1] == "~" for r in rules for t in r["tokens"]):
        pieces = F.flatten(F.transform(F.filter("tokens", lambda t: F.length(t) >= PIECE), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (PIECE - 1)), lambda i: F.concat(F.lit("~"), F.substring(t, i, F.lit(PIECE))))))
        urls = urls.withColumn("tokens", F.array_distinct(F.concat("tokens", pieces)))
    index = index_rules(urls, [r for r in rules if r["tokens"]])
    if rule_bytes(rules) <= BROADCAST_BYTES:
        index = F.broadcast(index)
    fetched = urls.withColumn("token", F.explode("tokens")).join(index, "token").drop("token")
    # The few rules that have no piece of literal text are a stated set, tried on all URLs in blocks.
    for block in _blocks([r for r in rules if not r["tokens"]]):
        bare = index_rules(urls, block).drop("token")
        fetched = fetched.unionByName(urls.withColumn("bare_", F.lit(True)).join(F.broadcast(bare.withColumn("bare_", F.lit(True))), "bare_").drop("bare_"))
    fits = fetched.filter(F.expr("CASE WHEN kind = 'site' THEN subject ELSE low END rlike regex"))
    order = F.struct((F.col("kind") != "site").alias("later"), (-F.col("rank")).alias("rank"), "rule", "rule_no", "verdict", "kind")
    decided = fits.groupBy("url").agg(F.min(order).alias(best)).select(F.col("url").alias(judged_url), best)
    out = marked.join(decided, F.col(url) == F.col(judged_url), "left")
    chosen = F.col(best)
    is_site = chosen["kind"] == "site"
    return out.select(
        *kept,
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        F.when(is_site, chosen["rule"]).alias("rule"),
        F.coalesce(chosen["verdict"], F.lit(default)).alias("verdict"),
        F.when(~is_site, chosen["rule"]).alias("pattern"),
    )


# The site rules of the query.
SITE_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: The words that the method's own rules are made of. A host label of
#: one word of each list, with a hyphen between, is blocked; so is an image below a
#: folder of a tracker's name.
FIRST_WORDS = "ad ads adult affiliate banner bet best bonus buy casino cheap click coupon crack crypto dating deal discount fast free gamble hack hot instant jackpot keygen live loan lotto lucky mega online pharma pills poker popup porn promo rx sex slots spam super torrent track viagra vip warez win xxx".split()
SECOND_WORDS = "ads bank bets bonus cash casino club deals direct download dvd farm farms feed games gold guru hub king land links loans lotto mall market mart max meds money now pills play poker pro promo sales shop slots spin sport stats store stream track traffic tube vault vip win wins world x xxx zone".split()
TRACKERS = "adclick adserver beacon clicktrack collect counter doubleclick impression pagead pixel popunder retarget telemetry webbug".split()


def own_rules() -> list[tuple[str, str]]:
    """Some 2,900 pattern rules."""
    hosts = [f"||{a}-{b}." for a in FIRST_WORDS for b in SECOND_WORDS if a != b]
    return [(r, "block") for r in [*hosts, *(f"/{t}/*.{kind}|" for t in TRACKERS for kind in ("gif", "png", "webp"))]]


def query_rules() -> list[dict]:
    return [site_rule(*r) for r in SITE_RULES] + [pattern_rule(*r) for r in own_rules()]


def oracle() -> str:
    """Every rule on every page, for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # A host label that goes on with a dot is plain text between dots.
    label = lambda r: quoted("." + r["rule"][2:]) if re.fullmatch(r"\|\|[a-z0-9.-]+\.", r["rule"]) else "NULL"
    values = ",\n".join(f"({quoted(r['rule'])}, {quoted(r['verdict'])}, {quoted(r['kind'])}, {quoted(r['regex'])}, {r['rank']}, {label(r)})" for r in query_rules())
    return rf"""
WITH rules(rule, verdict, kind, regex, rank, label) AS (VALUES
{values}),
p AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)\z', 1) AS rest
  FROM pages),
u AS (SELECT DISTINCT url, host || rest AS subject, translate(host || rest, '{_UPPER}', '{_LOWER}') AS low FROM p),
fits AS (
  SELECT u.url, r.*, row_number() OVER (PARTITION BY u.url ORDER BY (r.kind <> 'site'), r.rank DESC, r.rule) AS place
  FROM u JOIN rules r ON CASE WHEN label IS NOT NULL THEN contains('.' || regexp_extract(u.low, '^[^/?#]*'), label) ELSE regexp_matches(CASE WHEN r.kind = 'site' THEN u.subject ELSE u.low END, r.regex) END)
SELECT p.page_id, p.host, p.path,
       CASE WHEN f.kind = 'site' THEN f.rule END AS rule,
       coalesce(f.verdict, 'allow') AS verdict,
       CASE WHEN f.kind <> 'site' THEN f.rule END AS pattern
FROM p LEFT JOIN fits f ON f.url = p.url AND f.place = 1
"""
