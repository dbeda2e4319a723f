"""Operator 13, cost-balanced packing.

A sequence's cost is linear in its tokens plus quadratic in each of its pieces, as attention is
within pieces.  Documents go, longest first, whole to the sequence of lowest cost that has room;
where none has, the sequence of lowest cost is filled and the rest of the document is assigned
like a shorter one.  There are as many sequences as the tokens fill, and the rest of the tokens
gets sequences of powers of two, so none is padded.

Placing needs only lengths, which are at most the capacity: the plan is made on the driver from a
histogram of at most ``capacity`` counts, over runs of equal sequences.  Every document then finds
its places from its length and its rank among those of that length.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import scratch
from .common import id_and_text, map_texts, slices, table, tokenizer_path

#: Cost of n tokens in a piece: LINEAR * n + n * n, the ratio of a transformer of width 1,024 (6 * width).
LINEAR = 6144


class _Run:
    """Equal sequences first .. first + n - 1: so much room left, the next piece at offset ``at``."""

    __slots__ = ("at", "cost", "first", "live", "n", "room")

    def __init__(self, cost: int, first: int, n: int, room: int, at: int):
        self.cost, self.first, self.n, self.room, self.at, self.live = cost, first, n, room, at, True


def sequence_sizes(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(size, how many): full sequences, then powers of two below the capacity for the rest."""
    full, rest = divmod(tokens, capacity)
    return [(capacity, full)] * bool(full) + [(1 << b, 1) for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def plan(count: dict[int, int], capacity: int, linear: int = LINEAR) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, tokens taken, first sequence, offset, first rank of what is left) of each run of places.

    Rank r of a length, from a run's first rank on, puts its first ``taken`` tokens into sequence first + (r - first
    rank); the length - taken others have rank left + (r - first rank) among the documents of that length.
    """
    todo = [0] * (capacity + 1)
    for x, n in count.items():
        todo[x] += n
    fits: list[tuple] = []  # by cost; all have room for the current length
    short: list[list[_Run]] = [[] for _ in range(capacity + 1)]  # by room
    cheap: list[tuple] = []  # by cost; those in ``short``
    places, made = [], 0

    def put(run: _Run, x: int) -> None:
        if run.room >= x:
            heapq.heappush(fits, (run.cost, run.first, run))
        elif run.room:
            run.live = True
            short[run.room].append(run)
            heapq.heappush(cheap, (run.cost, run.first, run))

    for size, n in sequence_sizes(sum(x * n for x, n in enumerate(todo)), capacity):
        put(_Run(0, made, n, size, 0), capacity)
        made += n
    for x in range(capacity, 0, -1):
        for run in short[x]:
            if run.live:
                run.live = False
                heapq.heappush(fits, (run.cost, run.first, run))
        short[x] = []
        rank = 0
        while rank < todo[x]:
            if fits:
                run, taken = heapq.heappop(fits)[2], x
            else:
                run = heapq.heappop(cheap)[2]
                if not run.live:
                    continue
                run.live, taken = False, run.room
            n = min(run.n, todo[x] - rank)
            left = todo[x - taken] if taken < x else 0
            places.append((x, rank, taken, run.first, run.at, left))
            if taken < x:
                todo[x - taken] += n
            if n < run.n:
                put(_Run(run.cost, run.first + n, run.n - n, run.room, run.at), x)
            put(_Run(run.cost + linear * taken + taken * taken, run.first, n, run.room - taken, run.at + taken), x)
            rank += n
    return places


def encoded(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids, task, rank): a row for each full piece, without ids, and one for the rest of a document."""

    def work(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from . import bpe

        vocab, task, seen = bpe.load(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            ids, offsets = bpe.encode_texts(vocab, part.column("text"))
            flat = np.insert(ids, offsets[1:], end_id).astype("<u4")
            sizes = np.diff(offsets) + 1
            begin = np.cumsum(sizes) - sizes
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = begin[row] + start
            raw = memoryview(flat).cast("B")
            full = length == capacity
            spans = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            crc = [zlib.crc32(x) if f else None for x, f in zip(spans, full.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1] if len(order) else order
            within = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            rank = np.empty(len(order), np.int64)
            rank[order] = within + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            bodies = pa.array([None if f else x.tobytes() for x, f in zip(spans, full.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "doc_tokens": pa.array(sizes[row]), "ids_crc32": pa.array(crc, pa.int64()), "ids": bodies, "task": pa.array(np.full(len(row), task), pa.int32()), "rank": pa.array(rank)})

    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, task int, rank long"
    return map_texts(id_and_text(df, id_col, text_col), work, schema)


def pack_balanced(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, linear: int = LINEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row.

    Pieces of a row cover its ids and ``end_id`` once; each sequence is filled without gaps, to
    ``capacity`` or, for the last few, to a power of two.  A null or empty text is the end id alone; a
    null id stays null; repeated rows are packed each; documents of equal length are placed in the order
    of tasks; an empty table gives none; other columns are not read.
    """
    import numpy as np

    spark = df.sparkSession
    cut = scratch.materialise(encoded(df, tokenizer, end_id, capacity, id_col, text_col), "encoded")
    # one row for each task and length at most
    counts = scratch.materialise(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = np.array(plan(histogram, capacity, linear), np.int64).reshape(-1, 6)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    # a few runs for each length, however many documents there are
    sent = spark.sparkContext.broadcast(places)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # merged, not broadcast: there is a row for each task and length, which grow with the input
    ranked = cut.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")

    def work(batches):
        import zlib

        import pyarrow as pa

        places = sent.value
        key = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            start, length, rank = (batch.column(c).to_numpy() for c in ("start", "length", "rank"))
            whole = batch.column("ids_crc32").to_pylist()
            bodies, row, done = batch.column("ids"), np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            out = []
            while len(row):
                at = np.searchsorted(key, length << 44 | rank, "right") - 1
                _, first, taken, sequence, offset, left = places[at].T
                out.append((row, start + done, taken, sequence + rank - first, offset, done))
                more = taken < length
                row, start, done = row[more], start[more], (done + taken)[more]
                length, rank = (length - taken)[more], (left + rank - first)[more]
            row, start, taken, sequence, offset, done = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 6
            crc = []
            for i, a, k in zip(row.tolist(), done.tolist(), taken.tolist(), strict=True):
                known = whole[i]
                crc.append(known if known is not None else zlib.crc32(bodies[i].as_buffer()[4 * a : 4 * (a + k)]))
            where = pa.array(row)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(where), "start": pa.array(start), "length": pa.array(taken), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": batch.column("doc_tokens").take(where), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_texts(ranked, work, schema)


def op13_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_balanced(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
