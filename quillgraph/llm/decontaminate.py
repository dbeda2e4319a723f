"""Operator 6, benchmark decontamination by SimHash of item-sized windows.

For an item of L words, the windows of L words of a document are compared with it, and a document of
fewer words as a whole.  A window can
reach the wanted similarity only if enough of its shingles occur in items of that length, so
others are passed over.  The rest get a SimHash fingerprint, four blocks of 16 bits are looked up
with every change of up to four bits, which finds every item within 19 bits (were all four blocks
further off, the distance would be 20 at least), and candidates are verified by the exact weighted
Jaccard similarity of the shingle multisets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import id_and_text, map_texts, slices, table

RADIUS, PARTS = 19, 4


def normal_words(data, offsets):
    """(word hashes, row of each): A-Z lower-cased, ASCII punctuation taken out, words parted by ASCII white space."""
    import numpy as np

    from .text import IS_SPACE, LOWER, rows_of, word_hash, words_at

    keep = IS_SPACE.copy()
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    solid = keep[data]
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=place[1:])
    data, offsets = LOWER[data[solid]], place[offsets]
    starts, ends = words_at(data, offsets)
    return word_hash(data, starts, ends), rows_of(starts, offsets)


def simhash(bits):
    """Fingerprints of the rows of a (n, shingles) array of 64-bit hashes: a bit is set if more than half have it."""
    import numpy as np

    n, k = bits.shape
    ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(n, k, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(ones * 2 > k, axis=1).view(np.uint64).reshape(-1)


def window_prints(grams, starts, n: int):
    """(first, end, fingerprints) of stretches of the ascending window starts; memory is some MB, however long a window of n shingles is.

    Short windows are summed one by one; of long ones neighbours share the running sums of their bits.
    """
    import numpy as np

    if n <= 128:
        step = (1 << 18) // n
        for i in range(0, len(starts), step):
            yield i, min(i + step, len(starts)), simhash(grams[starts[i : i + step, None] + np.arange(n)[None, :]])
        return
    i = 0
    while i < len(starts):
        apart = np.flatnonzero(np.diff(starts[i : i + 4096]) > n)
        j = i + min(int(apart[0]) + 1 if len(apart) else 4096, int(np.searchsorted(starts[i : i + 4096], starts[i] + 8192, "right")))
        j = min(j, len(starts))
        ones = np.zeros((int(starts[j - 1] - starts[i]) + 1, 64), np.int32)
        first, total = int(starts[i]), np.zeros(64, np.int32)
        for a in range(0, n, 8192):  # the sum of the first window, then what enters less what leaves
            total += np.unpackbits(grams[first + a : first + min(a + 8192, n)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        ones[0] = total
        m = len(ones) - 1
        enter, leave = (np.unpackbits(grams[x : x + m].view(np.uint8).reshape(-1, 8), axis=1) for x in (first + n, first))
        ones[1:] = enter.astype(np.int32) - leave
        np.cumsum(ones, axis=0, out=ones)
        yield i, j, np.packbits(ones[starts[i:j] - first] * 2 > n, axis=1).view(np.uint64).reshape(-1)
        i = j


class Items:
    """The items of one block: fingerprints by length, their blocks of bits, and shingle multisets."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, least: float):
        import numpy as np
        import pyarrow as pa

        from .text import shingle_hash, utf8

        self.shingle, self.least = shingle, least
        words, row = normal_words(*utf8(pa.array(texts, pa.string())))
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        self.of_length: dict[int, dict] = {}
        grams = []
        for i, item in enumerate(ids):
            own = words[at[i] : at[i + 1]]
            if len(own):
                span = min(shingle, len(own))
                h = shingle_hash(own, span)
                grams.append(h)
                self.of_length.setdefault(len(own), {"ids": [], "sets": [], "rows": []})
                group = self.of_length[len(own)]
                group["ids"].append(item)
                group["rows"].append(h)
                group["sets"].append(np.unique(h, return_counts=True))
        for size, group in self.of_length.items():
            group["grams"] = np.unique(np.concatenate(group["rows"]))
            group["codes"] = simhash(np.stack(group["rows"]))
            group["span"] = min(shingle, size)
            n = size - group["span"] + 1
            # n shingles on either side: similarity s needs 2 n s / (1 + s) in common
            group["need"] = max(1, math.ceil(2 * n * least / (1 + least) - 1e-9))
            parts = group["codes"].view(np.uint16).reshape(-1, PARTS)
            group["order"] = [np.argsort(parts[:, j], kind="stable") for j in range(PARTS)]
            group["keys"] = [parts[o, j] for j, o in enumerate(group["order"])]
        self.spans = {}
        for span in {g["span"] for g in self.of_length.values()}:
            every = np.unique(np.concatenate([g["grams"] for g in self.of_length.values() if g["span"] == span]))
            seen = np.zeros(1 << 16, bool)
            seen[(every >> np.uint64(48)).astype(np.int64)] = True
            self.spans[span] = (every, seen)
        every = np.arange(1 << 16, dtype=np.uint16)
        self.changes = every[np.bitwise_count(every) <= RADIUS // PARTS]

    def near(self, group: dict, codes):
        """(window, item) pairs within RADIUS bits."""
        import numpy as np

        from .bpe import spread

        parts = codes.view(np.uint16).reshape(-1, PARTS)
        found = []
        for j in range(PARTS):
            for i in range(0, len(codes), 512):
                tried = (parts[i : i + 512, j, None] ^ self.changes[None, :]).reshape(-1)
                low, high = np.searchsorted(group["keys"][j], tried, "left"), np.searchsorted(group["keys"][j], tried, "right")
                hit = np.flatnonzero(high > low)
                item = group["order"][j][spread(low[hit], high[hit] - low[hit])]
                window = np.repeat(hit // len(self.changes) + i, high[hit] - low[hit])
                close = np.bitwise_count(codes[window] ^ group["codes"][item]) <= RADIUS
                found.append(window[close] * len(group["ids"]) + item[close])
        both = np.unique(np.concatenate(found))
        return both // len(group["ids"]), both % len(group["ids"])

    def search(self, words, row) -> dict:
        """{(row, item): (similarity, first word)} of the best window of each row and item that has one."""
        import numpy as np

        from .bpe import spread
        from .text import shingle_hash

        best: dict[tuple[int, int], tuple[float, int]] = {}
        begin = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else None

        def check(group, codes, windows, first):
            """Keep the best similarity of some windows, given their fingerprints, shingles and first words."""
            for w, item in zip(*(x.tolist() for x in self.near(group, codes)), strict=True):
                similarity = self.similarity(windows(w), group["sets"][item])
                if similarity >= self.least:
                    r = int(row[first[w]])
                    value, key = (similarity, -int(first[w] - begin[r])), (r, group["ids"][item])
                    best[key] = max(best.get(key, value), value)
        for span, (every, seen) in self.spans.items():
            if len(words) < span:
                continue
            grams = shingle_hash(words, span)
            maybe = np.flatnonzero(seen[(grams >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(every, grams[maybe])
            hits = maybe[every[np.minimum(at, len(every) - 1)] == grams[maybe]]
            hits = hits[row[hits] == row[hits + span - 1]]
            if not len(hits):
                continue
            for size, group in self.of_length.items():
                if group["span"] != span:
                    continue
                n = size - span + 1
                own = hits[np.isin(grams[hits], group["grams"])]
                self.whole_texts(own, grams, row, begin, span, size, n, group, check)
                if len(own) < group["need"]:
                    continue
                # a window with enough hits holds some hit and, need - 1 hits on, another: it starts between the two ends of that
                high = own[: len(own) - group["need"] + 1]
                low = own[group["need"] - 1 :] - n + 1
                some = low <= high
                low, high = low[some], high[some]
                low = np.maximum(low, np.r_[0, high[:-1] + 1])
                starts = spread(low, np.maximum(high - low + 1, 0))
                starts = starts[starts + size <= len(words)]
                starts = starts[row[starts] == row[starts + size - 1]]
                for i, j, codes in window_prints(grams, starts, n):
                    s = starts[i:j]
                    check(group, codes, lambda w, s=s, n=n: grams[s[w] : s[w] + n], s)
        return {k: (v[0], -v[1]) for k, v in best.items()}

    def whole_texts(self, own, grams, row, begin, span: int, size: int, n: int, group: dict, check) -> None:
        """Texts of fewer words than an item, but enough shingles, are one window each."""
        import numpy as np

        rows, found = np.unique(row[own], return_counts=True)
        words = begin[rows + 1] - begin[rows]
        m = words - span + 1
        # n and m shingles: similarity s needs (n + m) s / (1 + s) in common
        enough = (words < size) & (m >= self.least * n - 1e-9) & (found >= (n + m) * self.least / (1 + self.least) - 1e-9)
        for r, k in zip(rows[enough].tolist(), m[enough].tolist(), strict=True):
            window = grams[begin[r] : begin[r] + k]
            check(group, simhash(window[None, :]), lambda w, window=window: window, np.array([begin[r]]))

    @staticmethod
    def similarity(window, item) -> float:
        """Sum of smaller over sum of larger shingle counts."""
        import numpy as np

        names, counts = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(names, item[0], assume_unique=True, return_indices=True)
        common = int(np.minimum(counts[a], item[1][b]).sum())
        return common / (int(counts.sum()) + int(item[1].sum()) - common)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Broadcast-sized blocks of (ids, texts): the number follows the table's size, so any size is searched whole."""
    items = id_and_text(benchmark, id_col, text_col).where("doc_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for i in range(n):
        part = (items if n == 1 else items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == i)).distinct().toArrow()
        yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, least: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for each row and item with a window of at least that similarity.

    Items of fewer words than a shingle are one shingle; items without words, null items and null
    item ids match nothing, and so do null and empty texts.  A null document id is returned as
    null; repeated rows give repeated rows; ties take the earliest window; an empty table on
    either side gives none; other columns are not read.  Larger benchmarks are searched in blocks
    of about ``block_bytes``, one pass each.
    """
    spark = documents.sparkSession
    found = None
    for ids, texts in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast((ids, texts))

        def work(batches, sent=sent):
            import pyarrow as pa

            from .text import utf8

            items = Items(*sent.value, shingle, least)
            for part in slices(batches, limit=1 << 20):
                best = sorted(items.search(*normal_words(*utf8(part.column("text")))).items())
                if best:
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array([k[0] for k, _ in best])), "item_id": pa.array([k[1] for k, _ in best], pa.int64()), "similarity": [v[0] for _, v in best], "first_word": pa.array([v[1] for _, v in best], pa.int64())})

        one = map_texts(id_and_text(documents, id_col, text_col), work, "doc_id long, item_id long, similarity double, first_word long")
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, least: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``documents``, all columns, without those that ``find`` would return; no join and no shuffle."""
    spark = documents.sparkSession
    kept = documents
    scratch.ship(spark)
    for ids, texts in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast((ids, texts))

        def work(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            from .text import utf8

            items = Items(*sent.value, shingle, least)
            for part in slices(batches, text_col, 1 << 20):
                clean = np.ones(part.num_rows, bool)
                clean[[k[0] for k in items.search(*normal_words(*utf8(part.column(text_col))))]] = False
                yield part.filter(pa.array(clean))

        kept = map_texts(kept, work, documents.schema)
    return kept


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
