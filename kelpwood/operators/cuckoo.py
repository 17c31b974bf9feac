"""Duplicate suppression by an approximate set: scalable cuckoo filters, one for each range of hashes.

An owner task gets the occurrences of a range in the order in which they came, and
asks its filter whether it has seen a k-mer with a fingerprint. The filter may say
yes to one that it hasn't seen, as often as ``fpr`` says, and never no to one that
it has: no duplicate is counted, and hardly any occurrence is missed. It takes some
32 bits a pair (64 where ``fpr`` needs longer tags), where the exact form keeps pairs
of 128 bits until their counts are known.

Where counts are to be exact, the pairs are kept too, and what the filter says it has
seen is looked up among them: its no needs no look-up, its yes is never believed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import map_arrow

#: Places of a bucket, and how often a filter moves items before it is full.
SLOTS, MOVES = 4, 200
#: Buckets of the first filter of a range.
FIRST_BUCKETS = 1 << 10
#: Pairs of a range, about: a task has the filter and the counts of one range at a time.
RANGE_PAIRS = 2_000_000


class CuckooFilter:
    """A set of 64-bit numbers with 2^bits buckets of SLOTS tags; a tag is never 0."""

    def __init__(self, buckets: int, tag_bits: int, seed: int = 1):
        import numpy as np

        self.tags = np.zeros((buckets, SLOTS), np.uint32 if tag_bits <= 32 else np.uint64)
        self.mask, self.tag_bits, self.held, self.kicks = buckets - 1, tag_bits, 0, seed
        self.full = False

    def places(self, items):
        """The tag and both buckets of each item: the second is the first, moved by the tag."""
        import numpy as np

        tag = np.maximum(1, items >> np.uint64(64 - self.tag_bits)).astype(self.tags.dtype)
        first = (items & np.uint64(self.mask)).astype(np.int64)
        return tag, first, first ^ self.moved(tag)

    def moved(self, tag):
        import numpy as np

        return ((tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def has(self, items):
        """For each item whether its tag is in one of its buckets."""
        tag, first, second = self.places(items)
        return ((self.tags[first] == tag[:, None]) | (self.tags[second] == tag[:, None])).any(axis=1)

    def add(self, items):
        """Add items until one finds no place; returns those that are not in."""
        import numpy as np

        tag, first, second = self.places(items)
        rest = np.arange(len(items))
        for bucket in (first, second):
            rest = rest[~self._placed(tag[rest], bucket[rest])]
        done = 0
        for t, bucket in zip(tag[rest].tolist(), first[rest].tolist()):
            if not self._move(t, bucket):
                self.full = True
                break
            done += 1
        self.held += len(items) - len(rest) + done
        return items[rest[done:]]

    def _placed(self, tag, bucket):
        """Put tags into free slots of their buckets; which of them found one."""
        import numpy as np

        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        starts = np.flatnonzero(np.append(True, np.diff(at) != 0))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        free = self.tags[at] == 0
        mine = free & (np.cumsum(free, axis=1) == place[:, None] + 1)
        row, slot = np.nonzero(mine)
        self.tags[at[row], slot] = tag[order[row]]
        placed = np.zeros(len(bucket), bool)
        placed[order[row]] = True
        return placed

    def _move(self, tag: int, bucket: int) -> bool:
        """Put a tag in a full bucket and move what was there; all is undone if that doesn't end."""
        path = []
        for _ in range(MOVES):
            self.kicks = (self.kicks * 1103515245 + 12345) & 0x7FFFFFFF
            slot = self.kicks >> 16 & (SLOTS - 1)
            path.append((bucket, slot, int(self.tags[bucket, slot])))
            self.tags[bucket, slot] = tag
            tag = path[-1][2]
            bucket ^= (tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20 & self.mask
            there = self.tags[bucket].tolist()
            if 0 in there:
                self.tags[bucket, there.index(0)] = tag
                return True
        for at, slot, was in reversed(path):
            self.tags[at, slot] = was
        return False


class ScalableFilter:
    """Filters of doubling size; each has a tag bit more than the one before, so that
    all together say yes wrongly no more often than ``fpr``."""

    def __init__(self, fpr: float, buckets: int = FIRST_BUCKETS):
        # A look-up compares 2 * SLOTS tags; half of fpr is the first filter's, a quarter the second's.
        self.bits, self.buckets = math.ceil(math.log2(4 * SLOTS / fpr)), buckets
        if self.bits > 32:
            raise ValueError("a false positive rate below 4e-9 needs longer tags")
        self.filters: list[CuckooFilter] = []

    def has(self, items):
        import numpy as np

        found = np.zeros(len(items), bool)
        for f in self.filters:
            found |= f.has(items)
        return found

    def add(self, items) -> None:
        """Add distinct items that it doesn't have."""
        while len(items):
            if not self.filters or self.filters[-1].full:
                n = len(self.filters)
                self.filters.append(CuckooFilter(self.buckets << n, min(64, self.bits + n)))
            items = self.filters[-1].add(items)

    def bits_held(self) -> tuple[int, int]:
        """(bits of memory, items)."""
        return sum(f.tags.nbytes * 8 for f in self.filters), sum(f.held for f in self.filters)


class Pairs:
    """k-mers with the 64-bit numbers that stand for their fingerprints, as they are:
    runs in the order of the numbers, each more than twice as long as the next."""

    def __init__(self):
        self.runs: list[tuple] = []

    def has(self, items, h):
        """For each pair whether it is there."""
        import numpy as np

        found = np.zeros(len(items), bool)
        for known, of in self.runs:
            at, end = (np.searchsorted(known, items, side) for side in ("left", "right"))
            # Several k-mers may have the same number.
            while len(open_ := np.flatnonzero(at < end)):
                found[open_] |= of[at[open_]] == h[open_]
                at[open_] += 1
        return found

    def add(self, items, h) -> None:
        """Add pairs in the order of their numbers."""
        import numpy as np

        while self.runs and len(self.runs[-1][0]) <= 2 * len(items):
            known, of = self.runs.pop()
            items, h = np.concatenate([known, items]), np.concatenate([of, h])
            order = np.argsort(items, kind="stable")
            items, h = items[order], h[order]
        if len(items):
            self.runs.append((items, h))


def suppressed(h, fp0, fp1, known: ScalableFilter, counts: dict, cap: int | None, pairs: Pairs | None = None) -> None:
    """Count a batch of a range's occurrences, in their order; null fingerprints are told
    by a mask in fp0. With ``pairs`` what the filter says it has is looked up there."""
    import numpy as np

    from ..functions.kmers import _mixed

    marked = ~np.ma.getmaskarray(fp0)
    kmers, of = np.unique(h, return_inverse=True)
    n, flags = np.array([counts.get(k, (0, 0)) for k in kmers.tolist()], np.int64).T
    # For one k-mer, different fingerprints give different numbers.
    a, b = (_mixed(h.view(np.uint64) ^ _mixed(np.ma.getdata(x).view(np.uint64) + np.uint64(1))) for x in (fp0, fp1))
    new = ~marked | (a != b)
    # Nothing need be known of a k-mer that has reached the cap.
    rows = np.flatnonzero(marked if cap is None else marked & (flags[of] < cap))
    if len(rows):
        both, kmer, owner = np.stack([a[rows], b[rows]], 1).ravel(), np.repeat(h[rows], 2), np.repeat(rows, 2)
        order = np.lexsort((kmer, both))
        both, kmer, owner = both[order], kmer[order], owner[order]
        first = np.append(True, (np.diff(both) != 0) | (np.diff(kmer) != 0))
        group = np.cumsum(first) - 1
        items, kmer = both[first], kmer[first]
        had = known.has(items)
        missing = items[~had]
        if pairs is not None:
            doubt = np.flatnonzero(had)
            had[doubt] = pairs.has(items[doubt], kmer[doubt])
            pairs.add(items[~had], kmer[~had])
        # Different k-mers may have the same number, which the filter needs once.
        known.add(missing[np.append(True, np.diff(missing) != 0)] if len(missing) else missing)
        # Seen before this occurrence: by the filter, or earlier in the batch.
        new[owner[had[group] | (owner[first][group] < owner)]] = False
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    flag = new[order]
    flag[starts] |= n == 0
    before = np.cumsum(flag) - flag
    before += np.repeat(flags - before[starts], np.diff(starts, append=len(of)))
    counted = flag if cap is None else flag | (before >= cap)
    n, flags = n + np.add.reduceat(counted.astype(np.int64), starts), flags + np.add.reduceat(flag.astype(np.int64), starts)
    counts.update(zip(kmers.tolist(), zip(n.tolist(), flags.tolist())))


def approximate_sketch(
    occurrences: DataFrame, fpr: float = 1e-4, cap: int | None = None, range_pairs: int = RANGE_PAIRS, exact: bool = False, expected: int | None = None
) -> DataFrame:
    """Occurrences (sample, h, occ, fp0, fp1) to counts (sample, h, cnt): the rule of
    sample_sketch, with an approximate set. No count is above the exact one; an
    occurrence is wrongly taken for a duplicate about as often as ``fpr``, and never
    with ``exact``, where a range's pairs are kept, of each k-mer until the cap.

    A k-mer's occurrences meet in one task, as its count depends on their order; the
    task keeps one range's filter and counts. There are as many ranges as the number of
    occurrences asks for: they are counted, unless ``expected`` says about how many there
    are. That sets memory, not results.
    """
    rows = occurrences.select("sample", "h", "occ", "fp0", "fp1")
    ranges = max(1, math.ceil(2 * (rows.count() if expected is None else expected) / range_pairs))
    part = F.pmod(F.xxhash64("sample", "h"), F.lit(ranges)).cast("int")
    sample = rows.schema["sample"]
    schema = T.StructType([sample, T.StructField("h", T.LongType()), T.StructField("cnt", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from kelpwood.operators.cuckoo import Pairs, ScalableFilter, suppressed

        def result(of, counts: dict, kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of] * len(counts), kind), pa.array(list(counts), pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["sample", "h", "cnt"])

        now, known, pairs, counts, kind = None, None, None, {}, None
        for batch in batches:
            kind = batch.column(1).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if now is None or keys[a] != now:
                    if counts:
                        yield result(now[1], counts, kind)
                    now, known, pairs, counts = keys[a], ScalableFilter(fpr), Pairs() if exact else None, {}
                h = batch.column(2).slice(a, b - a).to_numpy()
                fps = [batch.column(c).slice(a, b - a) for c in (3, 4)]
                masked = [np.ma.array(x.fill_null(0).to_numpy(), mask=x.is_null().to_numpy(zero_copy_only=False)) for x in fps]
                suppressed(h, *masked, known, counts, cap, pairs)
        if counts:
            yield result(now[1], counts, kind)

    dealt = rows.select(part.alias("part"), "sample", "h", "fp0", "fp1", "occ")
    return map_arrow(dealt.repartition("part", "sample").sortWithinPartitions("part", "sample", "occ"), run, schema)
