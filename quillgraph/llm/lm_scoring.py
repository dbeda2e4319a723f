"""Operator 4, language-model scores by logistic context mixing, and smoothed unigram scores.

``context_mixing`` says what a text's decisions are and how their predictions are mixed.  What it
needs of the corpus is counted here, over all training rows at any size: which words are the most frequent
(the codebook, a bounded table), the letters of the others, how often each word occurs, and which word followed each two words
how often.  Texts are dealt into units; a unit sends its distinct words and pairs of (two words,
next word) with their counts by ranges of their hashes, and gets back, in the order in which it
asked, how often the corpus has each word, and the most frequent follower of each two words.
Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import map_texts, slices, table

ROWS = "kind string, unit int, bucket int, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
FOLLOWER_BITS = 16


def prepared(df: DataFrame, id_col: str, text_col: str, held: str) -> DataFrame:
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.withColumn("held_out", F.coalesce(F.expr(held), F.lit(False)))


def summed(keys, counts):
    """Distinct keys, sorted, and the sums of their counts."""
    import numpy as np

    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys):
    """(distinct keys, sorted; place of each key among them)."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def pack(keys, counts) -> bytes:
    """Sorted 64-bit keys by their differences in 32 bits (larger ones apart), and counts in one byte (larger ones apart)."""
    import numpy as np

    gap = np.diff(keys, prepend=np.uint64(0))
    wide, many = gap >= np.uint64(0xFFFFFFFF), counts > 254
    if 2 * wide.sum() > len(keys):  # sparse keys as they are
        head, body = -1, [keys]
    else:
        head, body = int(wide.sum()), [np.where(wide, np.uint64(0xFFFFFFFF), gap).astype(np.uint32), gap[wide]]
    parts = [np.array([len(keys), head, many.sum()], np.int64), *body, np.where(many, 255, counts).astype(np.uint8), counts[many].astype(np.int64)]
    return b"".join(p.tobytes() for p in parts)


def unpack(blob: bytes):
    import numpy as np

    n, wide, many = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24
    if wide < 0:
        keys = np.frombuffer(blob, np.uint64, n, at)
        at += 8 * n
    else:
        gap = np.frombuffer(blob, np.uint32, n, at).astype(np.uint64)
        at += 4 * n
        gap[gap == np.uint64(0xFFFFFFFF)] = np.frombuffer(blob, np.uint64, wide, at)
        at += 8 * wide
        keys = np.cumsum(gap, dtype=np.uint64)
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, np.int64, many, at + n)
    return keys, counts


def ranges(keys, bits: int, parts: int, below: int = 0):
    """Where each of ``parts`` equal ranges of keys of that many bits begins in the sorted keys; ``below``: bits under them that don't count."""
    import numpy as np

    edges = [-(-(i << bits) // parts) << below for i in range(1, parts)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


def pair_keys(tokens, bits: int):
    """For each token ``bits`` of the hash of the two tokens before it, over FOLLOWER_BITS of its own."""
    import numpy as np

    own = tokens.hash >> np.uint64(24) & np.uint64((1 << FOLLOWER_BITS) - 1)
    return tokens.contexts() >> np.uint64(64 - bits) << np.uint64(FOLLOWER_BITS) | own


def narrow(values, kind) -> bytes:
    """Counts in a small unsigned type; those that don't fit are its largest value, and follow in 64 bits."""
    import numpy as np

    most = np.iinfo(kind).max
    large = values >= most
    return np.where(large, most, values).astype(kind).tobytes() + values[large].astype(np.int64).tobytes()


def widen(blob, n: int, kind, at: int = 0):
    """(counts that ``narrow`` packed at this place of the blob, the place behind them)."""
    import numpy as np

    small = np.frombuffer(blob, kind, n, at)
    at += small.nbytes
    large = np.flatnonzero(small == np.iinfo(kind).max)
    if not len(large):
        return small, at
    out = small.astype(np.int64)
    out[large] = np.frombuffer(blob, np.int64, len(large), at)
    return out, at + 8 * len(large)


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """((hash, n, word) of each distinct training word, bytes of all texts): exact counts, summed for each few MB of text first."""
    import numpy as np

    def work(batches):
        import pyarrow as pa

        from .bpe import spread
        from .context_mixing import Tokens

        def flush(held, size):
            hashes, n = summed(np.concatenate([h for h, *_ in held]), np.concatenate([c for _, c, _ in held]))
            every = np.concatenate([h for h, *_ in held])
            words = pa.concat_arrays([w for *_, w in held])
            at = np.argsort(every, kind="stable")
            first = at[np.searchsorted(every[at], hashes)]
            one = pa.array([b""], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.r_[hashes.view(np.int64), 0]), pa.array(np.r_[n, 0]), pa.array(np.r_[np.zeros(len(n), np.int64), size]), pa.concat_arrays([words.take(pa.array(first)), one])], names=["hash", "n", "bytes", "word"])

        held, size, waiting = [], 0, 0
        for part in slices(batches):
            t = Tokens(part.column("text"))
            size += len(t.data)
            waiting += len(t.data)
            own = np.flatnonzero(~part.column("held_out").to_numpy(zero_copy_only=False)[t.row] & ~t.is_end)
            hashes, first, n = np.unique(t.hash[own], return_index=True, return_counts=True)
            first = own[first]
            long = t.end[first] - t.start[first]
            body = t.data[spread(t.start[first], long)]
            held.append((hashes, n, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[0, np.cumsum(long)].astype(np.int32)), pa.py_buffer(body)])))
            if waiting >= 16 << 20:
                yield flush(held, size)
                held, size, waiting = [], 0, 0
        if held:
            yield flush(held, size)

    seen = scratch.materialise(map_texts(texts.select("text", "held_out"), work, "hash long, n long, bytes long, word binary"), "slice-words")
    size = seen.agg(F.sum("bytes")).first()[0] or 0
    words = scratch.materialise(seen.where("n > 0").groupBy("hash").agg(F.sum("n").alias("n"), F.min("word").alias("word")), "words")
    scratch.drop(seen)
    return words, size


def codebook_of(words: DataFrame, codebook: int):
    """(hashes, least count) of the words that occur most, at most ``codebook``, each twice or more."""
    import numpy as np

    top = words.where("n > 1").select("hash", "n").orderBy(F.desc("n"), "hash").limit(codebook).toArrow()
    hashes, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    least = int(n.min()) + (len(n) == codebook) if len(n) else 2
    return np.sort(hashes[n >= least]), least


def letter_counts(words: DataFrame, book) -> list[bytes]:
    """Packed counts of one byte before a letter, and of three, over the words outside the codebook, each once in the corpus."""
    sent = words.sparkSession.sparkContext.broadcast(book)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .bpe import spread
        from .context_mixing import before
        from .text import utf8

        total = np.zeros(SMALL, np.int64)
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(sent.value, hashes), max(len(sent.value) - 1, 0))
            new = sent.value[at] != hashes if len(sent.value) else np.ones(len(hashes), bool)
            data, offsets = utf8(batch.column("word").filter(pa.array(new)))
            size = np.diff(offsets) + 1
            begin = np.cumsum(size) - size
            text = np.full(int(size.sum()), 32, np.uint8)
            text[spread(begin, size - 1)] = data
            one, three = before(text, begin)
            np.add.at(total, one << 8 | text, 1)
            np.add.at(total, (1 << 16) + (three << 8 | text), 1)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], names=["key", "n"])

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        parts = [(b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])))], pa.binary())], names=["blob"])

    summed_up = map_texts(words.select("hash", "word"), work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most as many keys as there are contexts and letters
    return [r["blob"] for r in summed_up.mapInArrow(packed, "blob binary").collect()]


def ask(units: DataFrame, book, tasks: int, bits: int) -> DataFrame:
    """For each unit its words ('w'), its pairs ('p') and its small counts ('k': leaves by class), by range."""
    sent = units.sparkSession.sparkContext.broadcast(book)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .context_mixing import CLASSES, END_HASH, Tokens

        words = sent.value
        parts, pairs, trains, classes, unit = [], [], [], [], 0
        for part in slices(batches):
            unit = part.column("unit")[0].as_py()
            t = Tokens(part.column("text"))
            pairs.append(pair_keys(t, bits))
            classes.append(t.classes().astype(np.uint8))
            trains.append(~part.column("held_out").to_numpy(zero_copy_only=False)[t.row])
            parts.append(t.hash)
        if not parts:
            return
        train = np.concatenate(trains)
        every, place = distinct(np.concatenate(parts))
        at = np.minimum(np.searchsorted(words, every), max(len(words) - 1, 0))
        inside = words[at] == every if len(words) else np.zeros(len(every), bool)
        leaf = np.where(inside, at, len(words) + (every == END_HASH))
        of_class = np.bincount(np.concatenate(classes)[train].astype(np.int64) * (len(words) + 2) + leaf[place[train]], minlength=1)
        del classes, trains
        del parts
        keys = np.flatnonzero(of_class)
        cuts = [0, *np.searchsorted(keys, np.linspace(0, CLASSES * (len(words) + 2), tasks + 1)[1:-1]).tolist(), len(keys)]
        rows = [("k", b, pack((SMALL + keys[i:j]).astype(np.uint64), of_class[keys[i:j]])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        del of_class
        counts = np.bincount(place, weights=train, minlength=len(every)).astype(np.int64)
        cuts = ranges(every, 64, tasks)
        rows += [("w", b, pack(every[i:j], counts[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        del every, place
        # the pairs' counts have a low bit for those that a held-out text has too; keys have room for the train bit
        keys = np.concatenate(pairs) << np.uint64(1) | train
        del pairs
        keys.sort()
        train = keys & np.uint64(1)
        keys >>= np.uint64(1)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.add.reduceat(train.astype(np.int64), new) << 1 | (train[new] == 0)
        keys = keys[new]
        cuts = ranges(keys, bits, tasks, FOLLOWER_BITS)
        rows += [("p", b, pack(keys[i:j], counts[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([unit] * len(some), pa.int32()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some], pa.binary())], names=["kind", "unit", "bucket", "blob"])

    return map_texts(units.select("unit", "text", "held_out"), work, ROWS)


#: First of the keys of classes and leaves, after those of one byte and of three bytes before a letter.
SMALL = (1 << 16) + (1 << 23)


def answer(asked: DataFrame, book, tasks: int) -> DataFrame:
    """Replies to the units ('w': counts, 'p': followers), and for the model 'n' (totals), 'b' (codebook counts), 'k' (small counts)."""
    sent = asked.sparkSession.sparkContext.broadcast(book)

    def words_of(held):
        import numpy as np

        from .context_mixing import END_HASH

        parts = [unpack(blob) for *_, blob in held]
        every, total = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        yield "n", -1, held[0][1], np.array([total.sum(), (total > 0).sum(), (total == 1).sum()], np.int64).tobytes()
        wanted = np.append(sent.value, END_HASH)
        at = np.minimum(np.searchsorted(every, wanted), len(every) - 1)
        found = every[at] == wanted
        yield "b", -1, held[0][1], wanted[found].tobytes() + total[at[found]].tobytes()
        for (unit, bucket, _), (keys, _) in zip(held, parts, strict=True):
            yield "w", unit, bucket, narrow(total[np.searchsorted(every, keys)], np.uint32)

    def followers_of(held):
        import numpy as np

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i in range(0, len(held), 16):
            some = [unpack(blob) for *_, blob in held[i : i + 16]]
            keys, counts = summed(np.concatenate([keys, *(k for k, _ in some)]), np.concatenate([counts, *(c >> 1 for _, c in some)]))
        context = keys >> np.uint64(FOLLOWER_BITS)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        context, total = context[first], np.add.reduceat(counts, first)
        # the most frequent follower, of equal ones that of least hash
        top_count = np.maximum.reduceat(counts, first)
        best = counts == np.repeat(top_count, np.diff(np.r_[first, len(keys)]))
        where = np.where(best, np.arange(len(keys)), len(keys))
        top = keys[np.minimum.reduceat(where, first)] & np.uint64((1 << FOLLOWER_BITS) - 1)
        for unit, bucket, blob in held:
            own, mine = unpack(blob)
            c = own >> np.uint64(FOLLOWER_BITS)
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            at = np.searchsorted(context, c[new])
            # what the corpus has beside one occurrence in a training text here
            alone = (np.diff(np.r_[new, len(c)]) == 1) & (mine[new] == 2) & (total[at] == 1)
            more = ~alone & (total[at] > 0)
            at = at[more]
            parts = [np.packbits(more).tobytes(), top[at].astype(np.uint16).tobytes(), narrow(total[at], np.uint16), narrow(top_count[at], np.uint16)]
            yield "p", unit, bucket, b"".join(parts)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = {"w": [], "p": [], "k": []}
        for batch in batches:
            for kind, unit, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held[kind].append((unit, bucket, blob))

        def rows():
            # a task may have several buckets; each is answered on its own
            for kind, reply in (("w", words_of), ("p", followers_of)):
                for bucket in sorted({b for _, b, _ in held[kind]}):
                    yield from reply([x for x in held[kind] if x[1] == bucket])
            if held["k"]:
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for i in range(0, len(held["k"]), 16):
                    some = [unpack(blob) for *_, blob in held["k"][i : i + 16]]
                    keys, counts = summed(np.concatenate([keys, *(k for k, _ in some)]), np.concatenate([counts, *(c for _, c in some)]))
                yield "k", -1, held["k"][0][1], pack(keys, counts)

        some = []
        for row in rows():
            some.append(row)
            if len(some) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "unit", "bucket", "blob"])
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "unit", "bucket", "blob"])

    return asked.repartitionById(tasks, F.col("bucket")).mapInArrow(work, ROWS)


def build_model(counted: DataFrame, book, least: int, letters: list[bytes]):
    """The model from the replies; what is collected is bounded by the codebook, but for three numbers a bucket."""
    import numpy as np

    from .context_mixing import CLASSES, END_HASH, SPELL_BITS, Model

    got = counted.where("unit < 0").select("kind", "blob").toArrow().to_pylist()
    blobs = {k: [r["blob"] for r in got if r["kind"] == k] for k in "nbk"}
    totals = np.sum([np.frombuffer(b, np.int64) for b in blobs["n"]] or [np.zeros(3, np.int64)], axis=0)
    halves = [(np.frombuffer(b, np.uint64, len(b) // 16), np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2)) for b in blobs["b"]]
    hashes, counts = (np.concatenate([h[i] for h in halves]) if halves else np.zeros(0, kind) for i, kind in enumerate((np.uint64, np.int64)))
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    ends = int(counts[hashes == END_HASH].sum())
    own = np.zeros(len(book), np.int64)
    known = hashes != END_HASH
    own[np.searchsorted(book, hashes[known])] = counts[known]
    parts = [unpack(b) for b in [*blobs["k"], *letters]]
    keys, values = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate((np.uint64, np.int64)))
    keys = keys.astype(np.int64)
    classed = np.zeros((CLASSES, len(book) + 2))
    here = keys >= SMALL
    np.add.at(classed.reshape(-1), keys[here] - SMALL, values[here])
    one, three = np.zeros(1 << 16), np.zeros(1 << (SPELL_BITS + 8))
    np.add.at(one, keys[keys < 1 << 16], values[keys < 1 << 16])
    mid = (keys >= 1 << 16) & ~here
    np.add.at(three, keys[mid] - (1 << 16), values[mid])
    return Model(book, own, least, int(totals[0]), int(totals[1]), ends, int(totals[2]), classed, (one.reshape(256, 256), three.reshape(-1, 256)))


def unit_scores(left, right, model, tasks: int, bits: int, rate: float, calm: float):
    """The scores of a unit's texts from the replies to what it asked."""
    import numpy as np
    import pyarrow as pa

    from .bpe import spread
    from .context_mixing import Tokens, costs, followers

    left = left.combine_chunks()
    text, train_row = left.column("text"), ~left.column("held_out").to_numpy()
    sizes = pa.compute.binary_length(text).to_numpy().astype(np.int64)
    blobs = {(k, b): x for k, b, x in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True)}
    hashes, pairs, n_tokens = [], [], []
    for part in slices(iter(left.select(["text"]).to_batches())):
        t = Tokens(part.column("text"))
        hashes.append(t.hash)
        pairs.append(pair_keys(t, bits))
        n_tokens.append(t.last - t.first + 1)
    n_tokens = np.concatenate(n_tokens)
    first = np.cumsum(n_tokens) - n_tokens

    every, place = distinct(np.concatenate(hashes))
    del hashes
    symbol = model.symbols(every).astype(np.int32)[place]
    cuts = ranges(every, 64, tasks)
    count = np.concatenate([widen(blobs["w", b], cuts[b + 1] - cuts[b], np.uint32)[0] for b in range(tasks) if cuts[b] < cuts[b + 1]])[place].astype(np.int64)
    pairs = np.concatenate(pairs)
    fp = (pairs & np.uint64((1 << FOLLOWER_BITS) - 1)).astype(np.uint16)
    every, place = distinct(pairs >> np.uint64(FOLLOWER_BITS))
    del pairs
    cuts = ranges(every, bits, tasks)
    total, top_count, top = [], [], np.zeros(len(every), np.uint16)
    for b in range(tasks):
        n = cuts[b + 1] - cuts[b]
        if n:
            blob = blobs["p", b]
            at = -(-n // 8)
            more = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, at), count=n))
            top[cuts[b] + more] = np.frombuffer(blob, np.uint16, len(more), at)
            at += 2 * len(more)
            for into in (total, top_count):
                counts, at = widen(blob, len(more), np.uint16, at)
                whole = np.zeros(n, counts.dtype)
                whole[more] = counts
                into.append(whole)
    total, top_count = (np.concatenate(x) if x else np.zeros(0, np.uint16) for x in (total, top_count))
    del blobs
    total, top_count, top = total[place], top_count[place], top[place]
    out = np.zeros((6, len(n_tokens)))
    out[0] = n_tokens
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order] + 64)
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
        rows = order[i:j]
        t = Tokens(text.take(pa.array(rows)))
        at = spread(first[rows], n_tokens[rows])
        train = train_row[rows][t.row]
        n = len(rows)
        c = count[at]
        value = costs(t, model, symbol[at], c, train, followers(fp[at], train, total[at].astype(np.int64), top[at], top_count[at].astype(np.int64)), rate=rate, calm=calm)
        out[1, rows] = np.bincount(t.row, weights=c > 0, minlength=n)
        out[2, rows] = np.bincount(t.row, weights=np.log10(c + 1.0), minlength=n)
        out[3, rows] = np.bincount(t.row, weights=value, minlength=n) / math.log(10)
        out[4, rows] = np.bincount(t.row, weights=t.end - t.start + 1, minlength=n)
        i = j
    base = out[2] - out[0] * math.log10(model.n_tokens + model.n_kinds + 1)
    return pa.Table.from_pydict({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)), "train_tokens": pa.array(np.full(len(sizes), model.n_tokens)), "base_score": pa.array(base), "score": pa.array(out[3]), "bits_per_byte": pa.array(-out[3] / math.log10(2) / out[4])})


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: str = "crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2", unit_bytes: int = 16 << 20, codebook: int = 1 << 16, rate: float = 0.01, calm: float = 200.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    Learning uses the rows where ``held`` is not true.  base_score: sum over the tokens (words
    and one end) of log10((c + 1) / (N + V + 1)); score: log10 of the model's probability of the text, where a token of a training row is judged by the
    corpus without that one occurrence of it.  A null or empty text is the end alone.  A row with a null id
    counts as training.  Repeated rows count and are scored each; without training rows all
    counts are zero; an empty table gives no rows; other columns are not read.

    All counts are of all training rows, whatever their number, and exact: words, followers, and the
    letters of each word outside the codebook once.  Scores don't depend on partitions or tasks.  A task holds one unit's words and
    pairs, or one range of hashes: the units and ranges follow the bytes of the input.
    """
    spark = df.sparkSession
    scratch.ship(spark)
    texts = prepared(df, id_col, text_col, held)
    words, size = word_counts(texts)
    book, least = codebook_of(words, codebook)
    letters = letter_counts(words, book)
    scratch.drop(words)
    # tasks and units only say where counting is done: every count is of the whole corpus
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * unit_bytes)))
    units = max(1, -(-size // unit_bytes), min(tasks, size // max(unit_bytes // 8, 1)))
    # two contexts of a corpus of this size are mistaken for each other in one case of a hundred or so
    bits = min(47, max(30, size.bit_length() + 4))
    dealt = texts.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int"))
    counted = scratch.materialise(answer(ask(dealt.repartitionById(units, F.col("unit")), book, tasks, bits), book, tasks), "counts")
    sent = spark.sparkContext.broadcast(build_model(counted, book, least, letters))

    def work(left, right):
        return unit_scores(left, right, sent.value, tasks, bits, rate, calm)

    replies = counted.where("unit >= 0").select("unit", "kind", "bucket", "blob")
    return dealt.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(work, SCORES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
