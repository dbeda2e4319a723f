"""Operator 2, removal of repeated byte strings by suffix arrays.

Every window of ``size`` bytes is assigned to the least hash among its grams (a choice that equal
windows share), so a text falls into runs of windows with one anchor.  Runs are compared by hash:
of equal runs all but the earliest are repeats as a whole.  Where an anchor has several different
runs, their bytes are gathered in blocks by anchor, a two-stage suffix array of each block shows
the windows that are equal, and all but the earliest of each group are repeats.  Anchors that a
sample finds in many different contexts are dealt out by single windows instead, and so are those
that turn out to have more than ``most_runs`` different runs, so no task gathers them and a block
is of bounded size.  Hashes of a few MB of text are combined before they are sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import fresh, table, tidied

GRAM = 20
#: Bytes of one suffix-sorted block, and of text whose runs are combined before they are sent.
BLOCK, COMBINE = 2 << 20, 24 << 20
LAST = (1 << 63) - 1


def positioned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, tie, text): pos orders documents (null ids last), tie tells apart texts of one id."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("pos"), F.expr("cast(xxhash64(text) & 2147483647 AS int)").alias("tie"), "text")


def runs(data, offsets, size: int):
    """(row, start in its text, number of windows, anchor hash, run hash, window hash function) of one slice."""
    import numpy as np

    from .text import SpanHash, rows_of

    width = size - GRAM + 1
    n = len(data) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), None
    hashed = SpanHash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashed(at, at + GRAM)
    best = gram >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    row = rows_of(np.arange(n), offsets)
    whole = np.arange(n) + size <= offsets[row + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & whole)
    total = np.cumsum(whole)
    ends = np.r_[np.flatnonzero(new)[1:], n]
    count = total[ends[np.searchsorted(np.flatnonzero(new), first)] - 1] - total[first] + 1
    return row[first], first - offsets[row[first]], count, gram[anchor[first]], hashed(first, first + count + size - 1), hashed


def first_of(keys: list, pos, tie, start):
    """(order, is the earliest of its key): rows sorted by key, then position."""
    import numpy as np

    order = np.lexsort((start, tie, pos, *keys))
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, first


def merged(pos, tie, start, end) -> tuple:
    """Arrow arrays (pos, tie, spans): for each text its spans as pairs of 32-bit numbers, overlaps joined."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((start, tie, pos))
    pos, tie, start, end = pos[order], tie[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(pos):
        return pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())
    text = np.cumsum(np.r_[0, (pos[1:] != pos[:-1]) | (tie[1:] != tie[:-1])])
    reach = np.maximum.accumulate(end + (text << 34)) - (text << 34)
    new = np.ones(len(pos), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    spans = np.stack([start[at], reach[np.r_[at[1:], len(pos)] - 1]], axis=1).astype("<i4")
    begin = np.flatnonzero(np.r_[True, text[at][1:] != text[at][:-1]])
    sizes = np.r_[begin, len(at)] * 8
    body = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(spans))])
    return pa.array(pos[at[begin]], pa.int64()), pa.array(tie[at[begin]], pa.int32()), body


def pack(*columns) -> bytes:
    import numpy as np

    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, kinds: str) -> list:
    import numpy as np

    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in kinds.split(","):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * out[-1].itemsize
    return out


RUN, WINDOW, SPAN = "u8,u8,i8,i4,i4,i2", "u8,u8,i8,i4,i4", "i8,i4,i4,i4"


def crowded_anchors(texts: DataFrame, size: int, sample_rows: int, least: int, n: int):
    """Sorted hashes of the anchors with ``least`` or more different runs in a bounded sample of the n texts.

    They only choose the route of their windows; every route finds the same repeats.
    """
    import numpy as np

    share = min(1.0, 1.5 * sample_rows / max(n, 1))

    def work(batches):
        import pyarrow as pa

        from .common import slices
        from .text import utf8

        for part in slices(batches, limit=1 << 20):
            *_, anchor, run, _ = runs(*utf8(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64))], names=["anchor", "run"])

    sample = texts.sample(fraction=share, seed=5).limit(sample_rows).select("text")
    found = sample.mapInArrow(tidied(work), "anchor long, run long").distinct().groupBy("anchor").count().where(F.col("count") >= least).select("anchor").toArrow()
    return np.sort(found.column("anchor").to_numpy().view(np.uint64))


def deal(texts: DataFrame, size: int, tasks: int, crowded) -> DataFrame:
    """Blobs of runs ('r'), of single windows ('w') and of spans found already ('s'), each with its bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(crowded)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .common import slices
        from .text import utf8

        crowded = sent.value

        def flush(held, windows, turn):
            rows = []
            anchor, run, pos, tie, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = first_of([run, anchor], pos, tie, start)
            again = order[~first]
            spans = [(pos[again], tie[again], start[again], start[again] + count[again] + size - 1)]
            keep = order[first]
            bucket = (anchor[keep] >> np.uint64(20)) % np.uint64(tasks)
            by = np.argsort(bucket, kind="stable")
            keep, cuts = keep[by], np.searchsorted(bucket[by], np.arange(tasks + 1))
            for b in range(tasks):
                k = keep[cuts[b] : cuts[b + 1]]
                if len(k):
                    rows.append((b, "r", pack(anchor[k], run[k], pos[k], tie[k].astype("i4"), start[k].astype("i4"), count[k].astype("i2"))))
            if windows:
                one, two, wpos, wtie, wstart = (np.concatenate(x) for x in zip(*windows, strict=True))
                order, first = first_of([one, two], wpos, wtie, wstart)
                again, keep = order[~first], order[first]
                spans.append((wpos[again], wtie[again], wstart[again], wstart[again] + size))
                bucket = (one[keep] >> np.uint64(20)) % np.uint64(tasks)
                by = np.argsort(bucket, kind="stable")
                keep, cuts = keep[by], np.searchsorted(bucket[by], np.arange(tasks + 1))
                for b in range(tasks):
                    k = keep[cuts[b] : cuts[b + 1]]
                    if len(k):
                        rows.append((b, "w", pack(one[k], two[k], wpos[k], wtie[k].astype("i4"), wstart[k].astype("i4"))))
            pos, tie, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
            for i in range(0, len(pos), 8192):  # a few at a time, so that no bucket gets all of a task's
                k = slice(i, i + 8192)
                rows.append(((turn * 31 + i // 8192) % tasks, "s", pack(pos[k], tie[k].astype("i4"), start[k].astype("i4"), end[k].astype("i4"))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

        from pyspark import TaskContext

        held, windows, seen, turn = [], [], 0, TaskContext.get().partitionId()
        for part in slices(batches, limit=1 << 20):
            data, offsets = utf8(part.column("text"))
            row, start, count, anchor, run, hashed = runs(data, offsets, size)
            if len(row):
                pos, tie = part.column("pos").to_numpy()[row], part.column("tie").to_numpy()[row]
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                    busy = np.flatnonzero(crowded[at] == anchor)
                    if len(busy):
                        from .bpe import spread

                        s = spread(start[busy], count[busy])
                        owner = np.repeat(busy, count[busy])
                        g = s + offsets[row[owner]]
                        half = size // 2
                        windows.append((hashed(g, g + size), hashed(g, g + half), pos[owner], tie[owner], s))
                        rest = np.ones(len(row), bool)
                        rest[busy] = False
                        start, count, anchor, run, pos, tie = (x[rest] for x in (start, count, anchor, run, pos, tie))
                held.append((anchor, run, pos, tie, start, count))
            seen += len(data)
            if seen >= COMBINE and held:
                yield flush(held, windows, turn)
                held, windows, seen, turn = [], [], 0, turn + 7
        if held:
            yield flush(held, windows, turn)

    return texts.select("pos", "tie", "text").mapInArrow(tidied(work), "bucket int, kind string, blob binary")


def settle(dealt: DataFrame, size: int, tasks: int, most_runs: int) -> DataFrame:
    """(kind, pos, tie, body): spans ('s') by text, and the runs whose anchor has other runs too ('q'; 'c' if more than ``most_runs``)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        blobs = {"r": [], "w": [], "s": []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs[kind].append(blob)
        spans = [unpack(b, SPAN) for b in blobs["s"]]
        asked = None
        if blobs["r"]:
            anchor, run, pos, tie, start, count = (np.concatenate(x) for x in zip(*(unpack(b, RUN) for b in blobs.pop("r")), strict=True))
            order, first = first_of([run, anchor], pos, tie, start)
            again, keep = order[~first], order[first]
            spans.append([pos[again], tie[again], start[again], start[again] + count[again].astype("i4") + size - 1])
            own = anchor[keep]
            several = np.zeros(len(keep), bool)
            if len(keep):
                same = own[1:] == own[:-1]
                several[1:] |= same
                several[:-1] |= same
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            sizes = np.diff(np.r_[new, len(own)])
            crowded = np.repeat(sizes > most_runs, sizes)
            k, crowded = keep[several], crowded[several]
            by = np.lexsort((start[k], tie[k], pos[k], crowded))
            k, crowded = k[by], crowded[by]
            asked = (anchor[k], pos[k], tie[k], start[k], count[k].astype("i4"))
        if blobs["w"]:
            one, two, pos, tie, start = (np.concatenate(x) for x in zip(*(unpack(b, WINDOW) for b in blobs.pop("w")), strict=True))
            order, first = first_of([one, two], pos, tie, start)
            again = order[~first]
            spans.append([pos[again], tie[again], start[again], start[again] + np.int32(size)])
        names = ["kind", "pos", "tie", "body"]
        if spans:
            found = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(["s"] * len(found[0]), pa.string()), *found], names=names)
        if asked is not None and len(asked[0]):
            anchor, pos, tie, start, count = asked
            new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (tie[1:] != tie[:-1]) | (crowded[1:] != crowded[:-1])])
            cuts = np.r_[new, len(pos)].tolist()
            bodies = [pack(anchor[a:b], start[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(crowded[new], "c", "q").tolist(), pa.string()), pa.array(pos[new], pa.int64()), pa.array(tie[new], pa.int32()), pa.array(bodies, pa.binary())], names=names)

    return dealt.repartitionById(tasks, F.col("bucket")).select("kind", "blob").mapInArrow(tidied(work), "kind string, pos long, tie int, body binary")


def snippets(texts: DataFrame, asked: DataFrame, size: int, tasks: int) -> DataFrame:
    """(bucket, kind, blob): the bytes of the runs asked for, by anchor ('q'), and the windows of crowded anchors, by their hashes ('w')."""
    wanted = asked.groupBy("pos", "tie").agg(F.collect_list(F.when(F.col("kind") == "q", F.col("body"))).alias("bodies"), F.collect_list(F.when(F.col("kind") == "c", F.col("body"))).alias("crowded"))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .bpe import spread
        from .common import slices
        from .text import SpanHash, utf8

        for part in slices(batches, limit=4 << 20):
            data, offsets = utf8(part.column("text"))
            rows = []

            def asked_of(column, part=part):
                """(anchor, row, start, count) of the runs that a column asks for."""
                pieces = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))]
                for i, bodies in enumerate(part.column(column).to_pylist()):
                    for body in bodies:
                        anchor, start, count = unpack(body, "u8,i4,i4")
                        pieces.append((anchor, np.full(len(anchor), i), start, count))
                return (np.concatenate(x) for x in zip(*pieces, strict=True))

            def buckets(keys):
                """(bucket, positions) of the keys, bucket by bucket."""
                bucket = (keys >> np.uint64(20)) % np.uint64(tasks)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(tasks + 1))
                return ((b, order[cuts[b] : cuts[b + 1]]) for b in np.unique(bucket).tolist())

            every_pos, every_tie = part.column("pos").to_numpy(), part.column("tie").to_numpy()
            anchor, row, start, count = asked_of("bodies")
            for b, k in buckets(anchor):
                body = data[spread(offsets[row[k]] + start[k], (count[k] + size - 1).astype(np.int64))]
                rows.append((b, "q", pack(anchor[k], every_pos[row[k]], every_tie[row[k]], start[k].astype("i4"), count[k].astype("i4")) + body.tobytes()))
            anchor, row, start, count = asked_of("crowded")
            if len(anchor):
                at, own = spread(start.astype(np.int64), count.astype(np.int64)), np.repeat(row, count)
                hashed, place = SpanHash(data), offsets[own] + at
                one, two = hashed(place, place + size), hashed(place, place + size // 2)
                for b, k in buckets(one):
                    rows.append((b, "w", pack(one[k], two[k], every_pos[own[k]], every_tie[own[k]].astype("i4"), at[k].astype("i4"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

    return texts.select("pos", "tie", "text").join(wanted, ["pos", "tie"]).select("pos", "tie", "text", "bodies", "crowded").mapInArrow(tidied(work), "bucket int, kind string, blob binary")


def block_spans(anchor, pos, tie, start, data, offsets, size: int):
    """(pos, tie, start, end) of the repeated windows of some runs' bytes, by a suffix array of the block."""
    import numpy as np

    from .suffix_array import Block

    block = Block(data, offsets)
    window, group = block.repeated(size)
    text = block.text[window]
    at = (window - block.first[text]).astype(np.int64) + start[text]
    order, first = first_of([group], pos[text], tie[text], at)
    again = order[~first]
    return pos[text[again]], tie[text[again]], at[again].astype(np.int32), (at[again] + size).astype(np.int32)


def compare(gathered: DataFrame, size: int, tasks: int) -> DataFrame:
    """('s', pos, tie, body) of the repeated windows inside each bucket, in blocks of whole anchors, and of crowded anchors by hash."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .bpe import spread

        heads, bodies, windows = [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == "w":
                    windows.append(unpack(blob, WINDOW))
                    continue
                head = unpack(blob, "u8,i8,i4,i4,i4")
                heads.append(head)
                bodies.append(np.frombuffer(blob, np.uint8, offset=8 + 28 * len(head[0])))
        if windows:
            one, two, pos, tie, start = (np.concatenate(x) for x in zip(*windows, strict=True))
            order, first = first_of([one, two], pos, tie, start)
            again = order[~first]
            found = merged(pos[again], tie[again], start[again], start[again] + np.int32(size))
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(["s"] * len(found[0]), pa.string()), *found], names=["kind", "pos", "tie", "body"])
        if not heads:
            return
        anchor, pos, tie, start, count = (np.concatenate(x) for x in zip(*heads, strict=True))
        data = np.concatenate(bodies)
        sizes = count.astype(np.int64) + size - 1
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(anchor, kind="stable")
        ends = np.cumsum(sizes[order])
        edges = np.r_[np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, len(order)]
        a = 0
        while a < len(order):
            most = (ends[a - 1] if a else 0) + BLOCK
            fit = edges[np.searchsorted(edges, a, "right") :]
            b = int(fit[max(0, np.searchsorted(ends[fit - 1], most, "right") - 1)])
            k = order[a:b]
            found = block_spans(anchor[k], pos[k], tie[k], start[k], data[spread(begin[k], sizes[k])], np.r_[0, np.cumsum(sizes[k])], size)
            found = merged(*found)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(["s"] * len(found[0]), pa.string()), *found], names=["kind", "pos", "tie", "body"])
            a = b

    return gathered.repartitionById(tasks, F.col("bucket")).select("kind", "blob").mapInArrow(tidied(work), "kind string, pos long, tie int, body binary")


def repeated_spans(texts: DataFrame, size: int = 100, sample_rows: int = 4000, crowd: int = 24, most_runs: int = 20_000) -> DataFrame:
    """(pos, tie, spans): for each text with repeats the blobs of its spans; texts as from ``positioned``."""
    spark = texts.sparkSession
    scratch.ship(spark)
    n, total = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # a bucket is of some 32 MB of text at most, as its hashes are held together
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // (32 << 20)))
    crowded = crowded_anchors(texts, size, sample_rows, crowd, n)
    settled = scratch.materialise(settle(deal(texts, size, tasks, crowded), size, tasks, most_runs), "settled")
    compared = scratch.materialise(compare(snippets(texts, settled.where("kind <> 's'").select("kind", "pos", "tie", "body"), size, tasks), size, tasks), "compared")
    spans = settled.where("kind = 's'").select("pos", "tie", "body").unionByName(compared.select("pos", "tie", "body"))
    return spans.groupBy("pos", "tie").agg(F.collect_list("body").alias("spans"))


def removed_mask(spans: list, n: int):
    """Which of a text's n bytes the spans cover."""
    import numpy as np

    edge = np.zeros(n + 1, np.int32)
    for body in spans or ():
        pairs = np.frombuffer(body, "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``df``.

    Removed is each byte of a ``size``-byte string that also starts earlier: in a smaller id, or
    in the same text at an earlier place; strings are judged on the input.  A null text is an
    empty one.  A null id comes after all others.  Rows of one id with different texts count as
    documents in the order of a hash of their texts; rows equal in id and text are one document,
    and each gets its result.  Texts shorter than ``size`` bytes lose nothing; an empty table
    gives no rows; other columns are not read.
    """
    texts = positioned(df, id_col, text_col)
    joined = texts.join(repeated_spans(texts, size), ["pos", "tie"], "left").select("doc_id", "text", "spans")

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        from .common import slices
        from .text import utf8

        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            out = []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                gone = removed_mask(spans, len(text))
                kept = text[~gone].tobytes()
                out.append((kept, len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4])], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(tidied(work), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", size: int = 100) -> DataFrame:
    """The rows of ``df``, all columns, with what ``remove_repeats`` keeps of each text as the text.

    A character of which only some bytes are kept goes too.  ``chars_col``, if there is such a
    column, gets the new number of characters.  A null text stays null; columns of any names come through.
    """
    pos, tie, found = fresh(df, "pos", "tie", "spans")
    own = df.withColumns({pos: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), tie: (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))).cast("int")})
    spans = repeated_spans(positioned(df, id_col, text_col), size).select(F.col("pos").alias(pos), F.col("tie").alias(tie), F.col("spans").alias(found))
    joined = own.join(spans, [pos, tie], "left").select(*df.columns, found)

    def work(batches):
        import pyarrow as pa

        from .common import slices
        from .text import utf8

        for part in slices(batches, text_col):
            data, offsets = utf8(part.column(text_col))
            texts = part.column(text_col).to_pylist()
            for i, spans in enumerate(part.column(found).to_pylist()):
                if spans:
                    text = data[offsets[i] : offsets[i + 1]]
                    texts[i] = text[~removed_mask(spans, len(text))].tobytes().decode("utf-8", "ignore")
            part = part.drop_columns([found])
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, part.schema.field(text_col).type))

    out = joined.mapInArrow(tidied(work), df.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(df.schema[chars_col].dataType)) if chars_col in df.columns else out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
