"""Hierarchical best-fit packing of token sequences.

Pieces are dealt to partitions by a hash, so that each holds the mix of lengths
of the whole table however it is ordered. Round 0 packs each partition by itself
(best fit, longest first) and emits the bins that are nearly full. The underfull
bins, all of them, become items of the next round, where the bins of several
partitions meet in one task and are packed again, and so on up a tree until one
task is left, or until a round finds hardly anything to join any more. Bins that
are filled poorly are opened again: their pieces are items of their own. Each round
is written to the shared folder, so no round is computed twice and a lost
executor costs one round's tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, shared_folder, stored, whole_text

#: Items that meet in one task, about.
TASK_ITEMS = 50_000
#: Rounds end early when a round saves less than this share of its bins.
LEAST_GAIN = 0.0005
#: Bins filled less than this are opened again.
POOR = 0.875
#: Characters that are tokenised at once in a worker.
CHUNK_CHARS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes, capacity: int):
    """Best fit, longest first: (bin of each item, its offset there, fill of each bin).

    Items go to the bin with the least room that still holds them.
    """
    import numpy as np

    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    with_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            with_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32, and
    with ``with_ids`` the ids themselves (array<int>). A null text is empty and
    gives one piece that holds only the end id."""

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from .word_tokens import word_tokens

        tokens = word_tokens(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()

        def pieces(doc_ids: list, texts: list[str]):
            rows: list[tuple] = []
            for doc, ids in zip(doc_ids, tokens.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            held, texts_held, chars = [], [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                held.append(doc_ids[i].as_py())
                texts_held.append(text)
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield pieces(held, texts_held)
                    held, texts_held, chars = [], [], 0
            if held:
                yield pieces(held, texts_held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(rows, cut, PIECES + (", ids array<int>" if with_ids else ""))


def _packer(round_no: int, capacity: int, slack: int):
    """A function for mapInArrow that packs items: rows with the same sequence are
    one, unless it is open; then each row is one."""

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .packing import POOR, best_fit

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        if "sequence_id" in rows.column_names:
            alone = rows["open"].to_numpy()
            name = np.where(alone, -1 - np.arange(rows.num_rows), rows["sequence_id"].to_numpy())
            _, item = np.unique(name, return_inverse=True)
            inner = np.where(alone, 0, rows["offset"].to_numpy())
        else:
            item, inner = np.arange(rows.num_rows), 0
        sizes = np.bincount(item, weights=rows["length"].to_numpy()).astype(np.int64)
        bins, offsets, fills = best_fit(sizes, capacity)
        out = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        base = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        out = out.append_column("sequence_id", pa.array(base + bins[item]))
        out = out.append_column("offset", pa.array(offsets[item] + inner))
        fill = fills[bins[item]]
        out = out.append_column("full", pa.array(fill >= capacity - slack))
        out = out.append_column("open", pa.array(fill < POOR * capacity))
        yield from out.to_batches(max_chunksize=10_000)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 4096, slack: int = 16, per_task: int = TASK_ITEMS, fan_in: int = 8) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32) into sequences of at
    most ``capacity`` tokens: adds sequence_id and offset.

    A bin is nearly full, and emitted, when at most ``slack`` tokens are free;
    all others are items of the next round, about ``per_task`` of them in a task
    and at least ``fan_in`` tasks' bins together as long as that allows. A round
    with a single task is the last; so is one that joins hardly any items, since
    a task's items are a fair draw of all. Lengths must be from 1 to ``capacity``.
    """
    folder = shared_folder(pieces.sparkSession)
    schema = PIECES + ", sequence_id long, offset long, full boolean, open boolean"
    piece = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    bins = rows = pieces.count()
    items, item, round_no, done = pieces, piece, 0, None
    parts = max(1, math.ceil(rows / per_task))
    while True:
        dealt = items.repartition(parts, F.xxhash64(item, F.lit(round_no)))
        packed = stored(map_arrow(dealt, _packer(round_no, capacity, slack), schema), f"{folder}/round={round_no}")
        sizes = packed.groupBy("full").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sequence_id").alias("bins")).collect()
        made, rows = sum(r["bins"] for r in sizes), sum(r["rows"] for r in sizes if not r["full"])
        last = parts == 1 or not rows or bins - made < LEAST_GAIN * bins
        emitted = (packed if last else packed.filter("full")).drop("full", "open")
        done = emitted if done is None else done.unionByName(emitted)
        if last:
            return done
        bins = sum(r["bins"] for r in sizes if not r["full"])
        items, item = packed.filter("not full").drop("full"), F.when(F.col("open"), piece).otherwise(F.col("sequence_id"))
        parts = max(1, min(parts - 1, max(math.ceil(rows / per_task), math.ceil(parts / fan_in))))
        round_no += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenise whole texts and pack them: one row per piece with doc_id, piece,
    start, length, ids_crc32, sequence_id and offset.

    Defined results: a null or empty text is the end id alone; only texts of
    more than ``capacity`` ids are cut; repeated rows are packed as often as
    they occur; null ids pass through; an empty table gives an empty one.
    """
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    return pack_pieces(stored(pieces, f"{shared_folder(docs.sparkSession)}/pieces"), capacity, **options)
