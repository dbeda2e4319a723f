"""Operator 3, token ids in Huffman-coded files.

Texts are encoded once into a scratch table of 16-bit ids (a larger vocabulary is refused) with the corpus counts of the ids.  From
the global counts comes one canonical code of at most 16 bits.  Documents are dealt out by ranges
of their id, sorted, and written as blocks of about ``block_ids`` ids: rows of a Parquet dataset
(the container takes care of commits, retries and remote stores) that hold a coded payload with
checkpoints and the documents' ids and lengths.  The code book is one row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import id_and_text, map_texts, slices, table, tokenizer_path

BLOCK = "part int, block int, doc_ids binary, n_tokens binary, first long, payload binary"


def encoded(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary of little-endian 16-bit ids) for each row; ``end_id`` follows each text's ids."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from . import bpe

        vocab = bpe.load(tokenizer)
        if max(vocab.largest, end_id or 0) >= 1 << 16:
            raise ValueError(f"{tokenizer} has ids of 65,536 and above; the file format takes 16-bit ids")
        for part in slices(batches):
            ids, offsets = bpe.encode_texts(vocab, part.column("text"))
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            flat = ids.astype("<u2")
            body = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), body], names=["doc_id", "ids"])

    return map_texts(id_and_text(df, id_col, text_col), work, "doc_id long, ids binary")


def id_counts(ids: DataFrame, size: int = 1 << 16):
    """Corpus count of each id (an array of ``size``, whatever the number of documents)."""
    import numpy as np

    def work(batches):
        import pyarrow as pa

        from .text import utf8

        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = utf8(batch.column("ids"))
            total += np.bincount(data.view("<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = ids.select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    return out


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 18) -> None:
    """Encode ``df`` and write the files at ``path`` in ascending order of the id.

    Ids are of 16 bits: a vocabulary with larger ones raises before anything is written.  A null text is an empty one (the end id alone); a null id sorts first; rows of equal id are
    ordered by their ids' bytes; an empty table gives files without blocks.  Parts are ranges of
    the document id with about equal token counts, so one much repeated document id is the only
    thing that can't be parted; a text longer than a block makes a block of its own.
    """
    import numpy as np

    from .huffman import Code, code_lengths

    spark = df.sparkSession
    ids = scratch.materialise(encoded(df, tokenizer, end_id, id_col, text_col), "token-ids")
    lengths = code_lengths(id_counts(ids))
    sent = spark.sparkContext.broadcast(lengths)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.withColumn("size", F.length("ids")).repartitionByRange(tasks, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "size", "ids").withColumn("part", F.spark_partition_id())

    def work(batches):
        import pyarrow as pa

        from .text import utf8

        code = Code(sent.value)
        held, number, first, part = [], 0, 0, 0

        def block():
            nonlocal held, number, first
            flat = np.concatenate([x for _, x in held])
            sizes = np.array([len(x) for _, x in held], "<i8")
            docs = pa.array([d for d, _ in held], pa.int64())
            known = np.array(docs.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            body = docs.fill_null(0).to_numpy().astype("<i8").tobytes() + known.tobytes()
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "doc_ids": [body], "n_tokens": [sizes.tobytes()], "first": pa.array([first], pa.int64()), "payload": [code.encode(flat)]})
            first += len(flat)
            number, held = number + 1, []
            return row

        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column("ids"))
            flat, at = data.view("<u2"), (offsets // 2).tolist()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                held.append((d, flat[at[i] : at[i + 1]]))
                size += at[i + 1] - at[i]
                if size >= block_ids:
                    yield block()
                    size = 0
        if held:
            yield block()

    ordered.select("part", "doc_id", "ids").mapInArrow(work, BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.astype(np.uint8).tobytes()),)], "lengths binary").write.mode("overwrite").parquet(f"{path}/code")
    scratch.drop(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary of little-endian 32-bit ids) of each document in the files at ``path``.

    start: ids of all documents before it.  Blocks decode independently; what comes before a part
    is summed over one number a part.
    """
    import numpy as np

    from .huffman import Code

    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8).astype(np.int64)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    sent = spark.sparkContext.broadcast(lengths)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            n = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column("n_tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(n, pa.int64())], names=["part", "n"])

    scratch.ship(spark)
    # one row for each part: their number is that of the tasks that wrote them
    parts = sorted(blocks.select("part", "n_tokens").mapInArrow(sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, at = {}, 0
    for p, n in parts:
        before[p], at = at, at + n

    def work(batches):
        import pyarrow as pa

        code = Code(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["payload"]).astype("<u4")
                n = np.frombuffer(row["n_tokens"], "<i8")
                docs = np.frombuffer(row["doc_ids"], "<i8", len(n))
                known = np.frombuffer(row["doc_ids"], np.uint8, len(n), 8 * len(n)) == 1
                ends = np.cumsum(n)
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=~known), pa.array(before[row["part"]] + row["first"] + ends - n), body], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(work, "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
