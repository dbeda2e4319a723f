"""Operator 7, best-fit packing after Martello-Toth dominance reduction.

Packing needs nothing of a piece but its length, and lengths are at most the capacity: the plan is
made on the driver from a histogram of at most ``capacity`` counts, in runs of equal sequences, so
its size does not depend on the number of documents.  The reduction fixes, for a long piece,
partner sets that provably dominate every alternative; best-fit decreasing packs the rest.  Every
piece then finds its sequence from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import scratch
from .common import id_and_text, map_texts, slices, table, tokenizer_path

#: A run of equal sequences: ((length, copies), ..) in each, and how many sequences.
Run = tuple[tuple[tuple[int, int], ...], int]


def reduce_dominated(count: dict[int, int], capacity: int) -> list[Run]:
    """Fix dominating sets and take them from ``count``; passes repeat until none applies.

    For a piece j with r = capacity - j left, and w the longest other piece of at most r: j alone
    dominates if nothing fits; {j, w} dominates if w = r, if no two others fit together, or if no
    three do and no two are longer together than w; {j, w, b}, b the longest that fits beside both,
    dominates if no three others fit together and no two that are longer than b and shorter than w.
    """
    runs: list[Run] = []
    sizes = sorted(x for x in count if count[x] > 0)

    def take(x: int, n: int) -> None:
        count[x] -= n
        if not count[x]:
            sizes.pop(bisect_left(sizes, x))

    def others(j: int) -> list[int]:
        """The three shortest pieces beside one j."""
        out: list[int] = []
        for x in sizes:
            out += [x] * min(3, count[x] - (x == j))
            if len(out) >= 3:
                break
        return out[:3]

    def longest(j: int, most: int) -> int:
        """The longest piece of at most ``most`` beside one j, else 0."""
        at = bisect_left(sizes, most + 1) - 1
        while at >= 0 and count[sizes[at]] - (sizes[at] == j) < 1:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def best_pair(j: int, most: int) -> int:
        """The largest sum of two pieces of at most ``most`` beside one j, else 0."""
        best, low, high = 0, 0, bisect_left(sizes, most + 1) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            enough = count[a] - (a == j) >= (2 if a == b else 1) and count[b] - (b == j) >= 1
            if a + b > most:
                high -= 1
            else:
                if enough:
                    best = max(best, a + b)
                    low += 1
                elif count[a] - (a == j) < 1:
                    low += 1
                else:
                    high -= 1
        return best

    def beside(j: int, w: int, most: int) -> int:
        """The longest piece of at most ``most`` beside one j and one w, else 0."""
        at = bisect_left(sizes, most + 1) - 1
        while at >= 0 and count[sizes[at]] - (sizes[at] == j) - (sizes[at] == w) < 1:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def between(j: int, low: int, high: int) -> list[int]:
        """The two shortest pieces beside one j that are longer than ``low`` and shorter than ``high``."""
        out: list[int] = []
        for x in sizes[bisect_left(sizes, low + 1) : bisect_left(sizes, high)]:
            out += [x] * min(2, count[x] - (x == j))
            if len(out) >= 2:
                break
        return out[:2]

    changed = True
    while changed:
        changed = False
        for j in sorted(sizes, reverse=True):
            while count[j] > 0:
                left, short = capacity - j, others(j)
                if not short or short[0] > left:
                    n = count[j] if short and short[0] > left and (short[0] != j or 2 * j > capacity) else 1
                    runs.append((((j, 1),), n))
                    take(j, n)
                    changed = True
                    continue
                w = longest(j, left)
                fixed = w == left or len(short) < 2 or short[0] + short[1] > left
                if not fixed and (len(short) < 3 or sum(short) > left):
                    fixed = w >= best_pair(j, left)
                    b = 0 if fixed else beside(j, w, left - w)
                    if b and (len(some := between(j, b, w)) < 2 or sum(some) > left):
                        need = Counter((j, w, b))
                        n = min(count[x] // k for x, k in need.items())
                        runs.append((tuple(need.items()), n))
                        for x, k in need.items():
                            take(x, k * n)
                        changed = True
                        continue
                if not fixed:
                    break
                n = count[j] // 2 if w == j else min(count[j], count[w])
                if w == j:
                    runs.append((((j, 2),), n))
                    take(j, 2 * n)
                else:
                    runs.append((((j, 1), (w, 1)), n))
                    take(j, n)
                    take(w, n)
                changed = True
    return runs


def best_fit_decreasing(count: dict[int, int], capacity: int) -> list[Run]:
    """Longest first, each into the fullest sequence that takes it, over runs of equal sequences."""
    open_runs: dict[int, list[list]] = {}
    room: list[int] = []
    closed: list[Run] = []

    def put(content: tuple, n: int, left: int) -> None:
        if not left:
            closed.append((content, n))
            return
        if left not in open_runs:
            open_runs[left] = []
            insort(room, left)
        open_runs[left].append([content, n])

    for x in sorted((x for x in count if count[x] > 0), reverse=True):
        rest = count[x]
        while rest:
            at = bisect_left(room, x)
            if at < len(room):
                left = room[at]
                content, n = open_runs[left].pop()
                if not open_runs[left]:
                    del open_runs[left]
                    room.pop(at)
            else:
                left, content, n = capacity, (), rest
            copies = min(left // x, rest)  # after one copy the same sequence is the fullest that takes the next
            used = min(n, rest // copies)
            put((*content, (x, copies)), used, left - copies * x)
            if used < n and left < capacity:
                put(content, n - used, left)
            rest -= used * copies
    return closed + [(c, n) for runs in open_runs.values() for c, n in runs]


def plan(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies, first sequence, offset) of each run of places.

    Rank r of the run, from its first rank on, goes to sequence first + r // copies at offset + (r % copies) * length.
    """
    count = dict(count)
    runs = reduce_dominated(count, capacity)
    runs += best_fit_decreasing(count, capacity)
    places, rank, sequence = [], {}, 0
    for content, n in runs:
        at = 0
        for x, copies in content:
            places.append((x, rank.get(x, 0), copies, sequence, at))
            rank[x] = rank.get(x, 0) + n * copies
            at += x * copies
        sequence += n
    return sorted(places)


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]); rank: among the task's pieces of that length."""

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
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = begin[row] + start
            raw = memoryview(flat).cast("B")
            spans = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1] if len(order) else order
            within = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            rank = np.empty(len(order), np.int64)
            rank[order] = within + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {"doc_id": part.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(x) for x in spans], pa.int64()), "task": pa.array(np.full(len(row), task), pa.int32()), "rank": pa.array(rank)}
            if with_ids:
                out["ids"] = pa.array([x.tobytes() for x in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    return map_texts(id_and_text(df, id_col, text_col), work, schema)


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each row.

    A row's ids and ``end_id`` are cut only if longer than ``capacity``.  A null or empty text is
    the end id alone; a null id stays null; repeated rows are packed each; an empty table gives
    none; other columns are not read.  ids, if asked for, are little-endian 32-bit.
    """
    import numpy as np

    spark = df.sparkSession
    cut = scratch.materialise(pieces(df, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    # one row for each task and length at most
    counts = scratch.materialise(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(places)
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # merged, not broadcast: there is a row for each task and length, which grow with the input
    ranked = cut.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))

    def work(batches):
        import pyarrow as pa

        places = sent.value
        key = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            _, first, copies, sequence, offset = places[at].T
            r = rank - first
            kept = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence + r // copies), "offset": pa.array(offset + r % copies * length)})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return map_texts(ranked.select(*names, "rank"), work, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
