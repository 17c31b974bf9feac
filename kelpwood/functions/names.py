"""File names, accessions, lineages and metadata cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings, and ways to say nothing in a metadata cell.
FASTQ = "fastq|fq|fnq"
FASTA = "fasta|fa|fna"
MISSING = ["", "-", "--", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "unknown", "unspecified", "unidentified", "uncalculated", "undetermined", "missing", "not applicable", "notapplicable", "not_applicable", "not collected", "not provided", "not available", "not determined", "not recorded", "no data", "restricted access", "withheld", "n/d", "nd"]
MISSING_START = r"^(missing|not applicable|not collected|not provided|not available|restricted access)\s*[:;]"
RANK_ENDINGS = [("s", ""), ("g", " sp."), ("f", " (family)"), ("o", " (order)"), ("c", " (class)"), ("p", " (phylum)"), ("d", " (domain only)")]


def route(name: Column, database: str = "refdb", sample: str = "sample") -> Column:
    """What a file is, by its ending: database, sketch, fastq, fasta or unknown."""
    ends = lambda x: F.lower(name).rlike(rf"\.({x})(\.gz)?$")
    return F.when(name.rlike(rf"\.{database}$"), "database").when(name.rlike(rf"\.{sample}$"), "sketch").when(ends(FASTQ), "fastq").when(ends(FASTA), "fasta").otherwise("unknown")


def mate_key(name: Column) -> tuple[Column, Column]:
    """(key, mate) of a mate's file name, null for others.

    The name without its ending is split at dots, underscores and hyphens. The
    first part that is 1 or 2, or these behind an R, is the mate's marker, if
    something stands before it and no part after it is empty. The key is the
    name without marker and ending, so that mates agree on all else.
    """
    stem = F.regexp_extract(name, rf"(?i)^(.*)\.(?:{FASTQ})(?:\.gz)?$", 1)
    parts = F.split(stem, "[._-]")

    def is_marker(i: Column) -> Column:
        rest = F.slice(parts, i + 1, F.size(parts))
        return F.element_at(parts, i).rlike("^[Rr]?[12]$") & ((i > 2) | (parts[0] != "")) & ~F.array_contains(rest, "")

    at = F.try_element_at(F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: (i <= F.size(parts)) & is_marker(F.least(i, F.size(parts)))), F.lit(1))
    before = F.aggregate(F.slice(parts, 1, at - 1), at - 2, lambda n, x: n + F.length(x))
    marker = F.element_at(parts, at)
    key = F.concat(F.substring(stem, F.lit(1), before), F.substring(stem, before + F.length(marker) + 2, F.length(stem)))
    return F.when(at.isNotNull(), key), F.when(at.isNotNull(), F.right(marker, F.lit(1)).cast("int"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_endings(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), rf"(?i)\.({FASTQ})$", "")


def accession(raw: Column) -> Column:
    """What was typed or pasted as an accession: the last part of a URL, upper case."""
    trimmed = F.trim(raw)
    tail = F.regexp_extract(trimmed, r"^https?://\S*/([A-Za-z0-9]+)/?(?:[?#].*)?$", 1)
    return F.upper(F.when(tail != "", tail).otherwise(trimmed))


def is_accession(acc: Column) -> Column:
    return acc.rlike("^[A-Z]{3,6}[0-9]+$")


def is_missing(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return low.isin(MISSING) | low.rlike(MISSING_START)


def cleaned(value: Column) -> Column:
    return F.when(~is_missing(value), F.trim(value))


def country_parts(value: Column) -> tuple[Column, Column]:
    """(country, region) of "country: region: place"."""
    parts = F.filter(F.transform(F.split(cleaned(value), ":"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.array_join(F.slice(parts, 2, 100), ", ")
    return F.try_element_at(parts, F.lit(1)), F.when(rest != "", rest)


def lineage_name(lineage: Column) -> Column:
    """The name at the lowest rank that is filled, marked if that isn't the species."""
    found = [F.when((v := F.trim(F.regexp_extract(lineage, f"(?:^|;){p}__([^;]*)", 1))) != "", F.concat(v, F.lit(s))) for p, s in RANK_ENDINGS]
    return F.coalesce(*found, F.lit("unclassified"))


def archive_bin(acc: Column) -> Column:
    """Folder number of an accession of four letters and digits: a hundred in each."""
    return F.floor(F.substring(acc, 5, 20).cast("long") / 100)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's characters, as 8 hex digits."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(2166136261), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def in_daily_window(ts: Column, start: int, end: int) -> Column:
    """Whether a time of day lies from start to before end (minutes); end before start wraps midnight."""
    now = F.hour(ts) * 60 + F.minute(ts)
    return (now >= start) & (now < end) if start <= end else (now >= start) | (now < end)
