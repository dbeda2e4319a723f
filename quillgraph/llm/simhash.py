"""Operator 10, SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made in one pass.  Distinct ones are dealt out by five blocks of bits: two within
four bits agree in one block at least, so some bucket holds both.  A bucket above ``bucket_cap`` is
dealt out again by five blocks of its other bits, by the same argument.  In each task the
hierarchical index of ``gray_index`` links what it holds and returns a spanning forest, never all
pairs; star contractions over the forests give the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans import scratch
from .common import id_and_text, if_small, map_texts, slices, table


def fingerprint_text(text: bytes, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, high bit first: the bits that more than half of the shingles' XXH64 have set."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(shingle, len(words))
    n = len(words) - span + 1
    digest = xxhash.xxh64_digest
    a, b = starts[:n].tolist(), ends[span - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        raw = b"".join([digest(line[x:y], seed) for x, y in zip(a[i : i + 8192], b[i : i + 8192], strict=True)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def fingerprints(df: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row; bits as in ``fingerprint_text``."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .text import utf8

        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            raw = data.tobytes()
            at = offsets.tolist()
            codes = b"".join(fingerprint_text(raw[x:y], shingle) for x, y in zip(at[:-1], at[1:], strict=True))
            fp = np.frombuffer(codes, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_texts(df, work, "doc_id long, fp long")


def split(rows: DataFrame, parts: int) -> DataFrame:
    """Each row once for each of ``parts`` blocks of its ``rest`` (of ``width`` bits): the block's bits join the bucket, the others are the new rest."""
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("a", F.expr(f"width * i div {parts}")).withColumn("n", F.expr(f"width * (i + 1) div {parts} - a"))
    cut = cut.withColumns({"a": F.col("a").cast("int"), "n": F.col("n").cast("int")})
    bits = F.expr("shiftrightunsigned(rest, a) & (shiftleft(1L, n) - 1)")
    rest = F.expr("(rest & (shiftleft(1L, a) - 1)) | CASE WHEN a + n < 64 THEN shiftleft(shiftrightunsigned(rest, a + n), a) ELSE 0L END")
    return cut.select("fp", "rep", F.xxhash64("bucket", "i", bits).alias("bucket"), rest.alias("rest"), (F.col("width") - F.col("n")).alias("width"))


def dealt_out(distinct: DataFrame, radius: int, bucket_cap: int) -> DataFrame:
    """(fp, rep, bucket): by ``radius`` + 1 blocks of bits, and a bucket above the cap again by as many of the bits that are left.

    Two codes within the radius agree in one block at least at every level.  Below 12 bits a bucket
    has some thousand different codes at most, so it isn't split further.
    """
    rows = scratch.materialise(split(distinct.select("fp", "rep", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"), F.lit(64).alias("width")), radius + 1), "dealt")
    while True:
        sizes = rows.where("width >= 12").groupBy("bucket").agg(F.count("*").alias("members"))
        large = scratch.materialise(sizes.where(F.col("members") > bucket_cap).select("bucket", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return rows.select("fp", "rep", "bucket")
        marked = rows.join(if_small(large), "bucket", "left")
        rows = scratch.materialise(marked.where("large IS NULL").drop("large").unionByName(split(marked.where("large"), radius + 1)), "dealt")


def spanning_links(distinct: DataFrame, radius: int, bucket_cap: int) -> DataFrame:
    """(u, v) ids that connect what links of at most ``radius`` bits connect.  distinct: (fp, rep)."""
    spark = distinct.sparkSession
    keyed = dealt_out(distinct, radius, bucket_cap)

    def link(batches):
        import numpy as np
        import pyarrow as pa

        from .gray_index import forest

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            fp, rep, bucket = (t.column(c).to_numpy() for c in ("fp", "rep", "bucket"))
            a, b = forest(fp.view(np.uint64), bucket, radius)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["u", "v"])

    scratch.ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_texts(keyed.repartition(tasks, "bucket"), link, "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, bucket_cap: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``df``.

    Fingerprints that differ in ``radius`` bits or fewer are linked; component_id is the smallest
    doc_id reachable over links.  A null text is an empty one; texts without words have
    fingerprint zero and link like any other.  Rows with a null id keep a null id, take the
    component of their fingerprint, and carry no links of their own.  Repeated rows give repeated
    rows; an empty table gives none; other columns are not read.
    """
    prints = scratch.materialise(fingerprints(id_and_text(df, id_col, text_col), shingle), "prints")
    distinct = scratch.materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    links = spanning_links(distinct, radius, bucket_cap)
    joined = connected_components(links)
    of = distinct.join(joined.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands of two least shingle hashes that documents are dealt out by, and two more for crowded buckets.
BANDS, ROWS = 16, 4


def sketches(df: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, sig, n, fp, keys): of each row's set of shingles its name, size, fingerprint and, for each band, ROWS least hashes.

    Words as in ``fingerprint_text``; fewer words than a shingle are one; without words the set is empty.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, limit=1 << 20):
            own, grams, size = shingle_rows(part.column("text"), shingle)
            at = np.r_[0, np.cumsum(size)]
            some = np.flatnonzero(size)
            n = part.num_rows
            fp = np.zeros(n, np.uint64)
            keys = np.zeros((n, BANDS * ROWS), np.uint64)
            if len(some):
                begin = at[some]
                ones = np.add.reduceat(np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1), begin, axis=0, dtype=np.int32)
                fp[some] = np.packbits(ones * 2 > size[some][:, None], axis=1).view(np.uint64).ravel()
                for k in range(BANDS * ROWS):
                    turned = (grams ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    keys[some, k] = np.minimum.reduceat(turned ^ turned >> np.uint64(29), begin)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS * ROWS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signatures(grams, at).view(np.int64)), pa.array(size.astype(np.int32)), pa.array(fp.view(np.int64)), lists], names=["doc_id", "sig", "n", "fp", "keys"])

    return map_texts(df, work, "doc_id long, sig long, n int, fp long, keys array<long>")


def shingle_rows(column, shingle: int):
    """(row, distinct shingle hash) sorted, and how many each row of a text column has."""
    import numpy as np

    from .text import LOWER, rows_of, shingle_hash, utf8, word_hash, words_at

    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends = words_at(data, offsets)
    n = len(offsets) - 1
    words, row = word_hash(data, starts, ends), rows_of(starts, offsets)
    count = np.bincount(row, minlength=n)
    own, grams = [], []
    for span in range(1, shingle + 1):
        take = (count == span if span < shingle else count >= shingle)[row]
        h, of = shingle_hash(words[take], span), row[take]
        whole = of[: len(h)] == of[span - 1 :][: len(h)]
        own.append(of[: len(h)][whole])
        grams.append(h[whole])
    own, grams = np.concatenate(own), np.concatenate(grams)
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])][: len(own)]
    return own[fresh], grams[fresh], np.bincount(own[fresh], minlength=n)


def signatures(grams, at):
    """A name of each row's set; equal sets have equal names."""
    import numpy as np

    from .text import mix

    total = np.r_[np.uint64(0), np.cumsum(mix(grams), dtype=np.uint64)]
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """(sig, n, grams) of each row."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, limit=1 << 20):
            _, grams, size = shingle_rows(part.column("text"), shingle)
            at = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_arrays([pa.array(signatures(grams, at).view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))], names=["sig", "n", "grams"])

    return map_texts(df, work, "sig long, n int, grams array<long>")


def _buckets(named: DataFrame, bucket_cap: int) -> DataFrame:
    """(sig, fp, bucket) for each band; a bucket above the cap is split by a third and then a fourth least hash."""
    banded = named.select("sig", "fp", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> slice(keys, b * {ROWS} + 1, {ROWS}))")).alias("band", "k"))
    rows = banded.select("sig", "fp", "k", F.xxhash64("band", F.col("k")[0], F.col("k")[1]).alias("bucket"))
    for extra in range(2, ROWS):
        large = scratch.materialise(rows.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > bucket_cap).select("bucket", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            break
        rows = rows.join(if_small(large), "bucket", "left").select("sig", "fp", "k", F.when(F.col("large"), F.xxhash64("bucket", F.col("k")[extra])).otherwise(F.col("bucket")).alias("bucket"))
    return rows.select("sig", "fp", "bucket")


def _candidates(dealt: DataFrame, radius: int, known: bool) -> DataFrame:
    """(a, b) sigs, a < b: the pairs of ``nearest_pairs`` in each bucket.  dealt: (sig, fp, bucket[, label, bad]); bad: sigs that don't go with it."""

    def link(batches):
        import numpy as np
        import pyarrow as pa

        from .gray_index import nearest_pairs

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            sig, fp, bucket = (t.column(c).to_numpy() for c in ("sig", "fp", "bucket"))
            _, place, size = np.unique(bucket, return_inverse=True, return_counts=True)
            keep = size[place] > 1
            sig, label, barred = sig[keep], None, None
            if known:
                from .text import mix

                label, bad = t.column("label").to_numpy()[keep], t.column("bad").combine_chunks().filter(pa.array(keep))
                code = lambda x, y: mix(x.view(np.uint64)) * np.uint64(3) + mix(y.view(np.uint64))
                parents, other = bad.value_parent_indices().to_numpy(), bad.flatten().to_numpy()
                failed = np.unique(code(sig[parents], other))
                barred = lambda a, b: np.isin(code(sig[a], sig[b]), failed)
            a, b = nearest_pairs(fp[keep].view(np.uint64), place[keep], radius, label, barred)
            a, b = sig[a], sig[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_texts(dealt.repartition(tasks, "bucket"), link, "a long, b long").where("a <> b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, named: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of ``least`` or more."""
    keys = scratch.materialise(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct(), "keys")
    ids = scratch.materialise(named.join(if_small(keys), "sig", "left_semi").select(F.col("rep").alias("doc_id")), "ids")
    made = shingle_sets(texts.join(if_small(ids), "doc_id", "left_semi"), shingle).join(if_small(keys), "sig", "left_semi").dropDuplicates(["sig"])
    whole = scratch.materialise(made, "sets")
    left, right = (whole.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("grams").alias(f"grams_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    alike = both.where(F.col("common") + F.lit(1e-9) >= F.lit(least) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return scratch.materialise(alike.select("a", "b"), "alike")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 22, bucket_cap: int = 20_000) -> DataFrame:
    """(doc_id, component_id) for each row with an id; component_id is the smallest doc_id reachable over pairs of similarity ``least`` or more.

    Similarity is Jaccard's of the sets of shingles.  Two sets of 0.8 differ in 10 of 64 fingerprint
    bits on average, too many for blocks of bits, so fingerprints are dealt out by bands of least
    shingle hashes instead: at 0.8 a pair meets in one band at least but for one case in ten
    million.  In each bucket the Gray-order index finds pairs within ``radius`` bits (0.8 lies
    beyond 22 in some four of a million); a spanning forest of the nearest is verified by the
    whole sets, and between the parts that this leaves apart another one, without the pairs that
    failed.  Equal sets are one from the start, texts without words are equal; repeated rows give repeated rows.
    """
    spark = df.sparkSession
    texts = id_and_text(df, id_col, text_col).where("doc_id is not null")
    made = scratch.materialise(sketches(texts, shingle), "sketches")
    named = scratch.materialise(made.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "named")
    # sets of fewer than 1 / (1 - least) members are similar only if equal
    dealt = scratch.materialise(_buckets(named.where(F.col("n") > 1 / (1 - least) - 1.001), bucket_cap), "dealt")
    pairs = scratch.materialise(_candidates(dealt, radius, False), "pairs")
    links = _verified(pairs, texts, named, shingle, least)
    label = _labels(links, named)
    failed = pairs.join(links, ["a", "b"], "left_anti")
    bad = failed.union(failed.select("b", "a")).groupBy(F.col("a").alias("sig")).agg(F.collect_list("b").alias("bad"))
    apart = dealt.join(label.select("sig", F.col("component").alias("label")), "sig").join(bad, "sig", "left")
    more = _verified(scratch.materialise(_candidates(apart, radius, True), "pairs"), texts, named, shingle, least)
    of = _labels(links.union(more), named)
    return made.select("doc_id", "sig").join(of, "sig").select("doc_id", F.col("component").alias("component_id"))


def _labels(links: DataFrame, named: DataFrame) -> DataFrame:
    """(sig, component): the least id that links reach from each set."""
    ends = [named.select(F.col("sig").alias(k), F.col("rep").alias(n)) for k, n in (("a", "u"), ("b", "v"))]
    joined = connected_components(links.join(ends[0], "a").join(ends[1], "b").select("u", "v"))
    return scratch.materialise(named.select("sig", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component")), "labels")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
