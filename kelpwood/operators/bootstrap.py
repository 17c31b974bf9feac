"""Resampling intervals for the coverage estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.workers import map_arrow

SCHEMA = "sample string, genome long, ani_low double, ani_high double, lambda_low double, lambda_high double"


def _ratio(counts, values, min_count: float):
    """The ratio estimator on each row of counts (columns are the count values)."""
    import numpy as np

    n = counts[:, values > 0]
    v = values[values > 0]
    nonzero, kinds = n.sum(1), (n > 0).sum(1)
    best = n.max(1, keepdims=True)
    mode = np.where(n == best, v, -1).max(1)
    at = {x: k for k, x in enumerate(v.tolist())}
    following = np.array([n[i, at[m + 1]] if m + 1 in at else 0 for i, m in enumerate(mode.tolist())])
    good = (kinds != 1) & (nonzero >= 25) & (following >= min_count) & (best[:, 0] >= min_count)
    return np.where(good, following / np.maximum(best[:, 0], 1) * (mode + 1), np.nan)


def intervals(rows: DataFrame, k: int, rounds: int = 100, seed: int = 7, min_count: float = 3.0) -> DataFrame:
    """Coverage rows to 5 and 95 percent bounds of identity and lambda over
    ``rounds`` resamples of the counts; null if fewer than 50 give an estimate.

    Resampling k-mers with replacement is a multinomial draw over the histogram,
    so only histograms are read. Results are the same for a seed and pair.
    """
    from collections.abc import Iterator

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from kelpwood.operators.bootstrap import _ratio

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                values = np.array([0] + [h["cnt"] for h in r["hist"]])
                n = np.array([r["zeros"]] + [h["n"] for h in r["hist"]], float)
                rng = np.random.default_rng(seed + zlib.crc32(f"{r['sample']}/{r['genome']}".encode()))
                draws = rng.multinomial(int(n.sum()), n / n.sum(), size=rounds)
                lam = _ratio(draws, values, min_count)
                with np.errstate(all="ignore"):
                    ani = (draws[:, 1:].sum(1) / (1 - np.exp(-lam)) / n.sum()) ** (1 / k)
                ok = ~np.isnan(lam) & ~np.isnan(ani)
                m = int(ok.sum())
                low, high = m * 5 // 100 - 1, m * 95 // 100 - 1
                a, b = np.sort(ani[ok]), np.sort(lam[ok])
                out.append((r["sample"], r["genome"], *((None,) * 4 if m < 50 else (float(a[low]), float(a[high]), float(b[low]), float(b[high])))))
            kinds = [pa.string(), pa.int64(), *[pa.float64()] * 4]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    return map_arrow(rows.filter("median <= 2").select("sample", "genome", "zeros", "hist"), run, SCHEMA)
