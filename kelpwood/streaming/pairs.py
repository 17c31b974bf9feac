"""Mates from two streams that advance as they like, paired in the order of their sides.

Each sample has a queue for each side, kept as state, and a pair leaves as soon as
both have a record. A side ends at its first record that is not ok, or at a mark;
once a side that has ended has nothing left, and both have been looked at, no byte
of the other can make a pair: the queues go, and what still comes is ignored. A side
that is rejected (not ok at -1) rejects its sample, as does one that never brought
anything; a side that is further ahead than ``lag`` records ends the sample too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Records that a side may be ahead, at most.
LAG = 100_000
#: kind: pair (idx, r1, r2); or done, rejected or drifted, once a sample, with the pairs before it as idx.
PAIRS = "sample string, kind string, idx long, r1 string, r2 string"
_FLAGS = "pairs long, parsed1 boolean, parsed2 boolean, ended1 boolean, ended2 boolean, over boolean"


def paired_stream(records: DataFrame, lag: int = LAG) -> DataFrame:
    """Streams of records (sample, mate, at, seq, ok) to PAIRS: mate is 1 or 2, at
    grows along a side and over batches, and a row with a null ok marks a side's end.

    The result doesn't depend on how rows fall into batches, as long as no side is
    ever further ahead than ``lag``. Needs the RocksDB state store. State of a
    sample: the queue of the side ahead, and six small figures, which stay when it
    is over, so that what comes late finds that out.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Pairing(StatefulProcessor):
        def init(self, handle) -> None:
            self.flags = handle.getValueState("flags", _FLAGS)
            self.queues = [handle.getListState(f"queue{m}", "seq string") for m in (1, 2)]

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            pairs, *parsed_ended, over = self.flags.get() if self.flags.exists() else (0, False, False, False, False, False)
            parsed, ended = parsed_ended[:2], parsed_ended[2:]
            new = pd.concat(list(rows))
            if over:
                return
            kind, queues = None, []
            for m in (0, 1):
                queue = [r[0] for r in self.queues[m].get()] if self.queues[m].exists() else []
                for at, seq, ok in new[new["mate"] == m + 1].sort_values("at")[["at", "seq", "ok"]].itertuples(index=False):
                    if at == -1:
                        kind = "rejected"
                    if ended[m]:
                        break
                    if ok is True or ok == True and ok is not None:  # noqa: E712  pandas has its own booleans
                        parsed[m] = True
                        queue.append(seq)
                    else:
                        parsed[m] = parsed[m] or not pd.isna(ok)
                        ended[m] = True
                queues.append(queue)
            n = min(map(len, queues))
            out = [("pair", pairs + i, queues[0][i], queues[1][i]) for i in range(n)] if kind is None else []
            pairs += len(out)
            left = [q[n:] for q in queues]
            if kind is None:
                if all(ended) and not all(parsed):
                    kind = "rejected"
                elif all(parsed) and any(e and not q for e, q in zip(ended, left)):
                    kind = "done"
                elif max(map(len, left)) > lag:
                    kind = "drifted"
            if kind:
                out.append((kind, pairs, None, None))
                left = [[], []]
            for state, queue in zip(self.queues, left):
                state.put([(s,) for s in queue]) if queue else state.clear()
            self.flags.update((pairs, *parsed, *ended, kind is not None))
            if out:
                frame = pd.DataFrame(out, columns=["kind", "idx", "r1", "r2"])
                frame.insert(0, "sample", key[0])
                yield frame

        def close(self) -> None:
            pass

    return records.groupBy("sample").transformWithStateInPandas(Pairing(), PAIRS, "Append", "None")
