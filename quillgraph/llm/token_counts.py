"""Operator 5, token counts by the whole-token shortcut.

``Vocabulary.single`` holds the vocabulary strings proven, by encoding each of them, to be one
token as a pre-token.  A pre-token in that table counts one; only the rest is merged.  Counts are
made once for each distinct word of a few MB of text and added up by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import id_and_text, map_texts, slices, table, tokenizer_path


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``df``, in one pass without a shuffle.

    ``tokenizer``: path of a byte-level BPE file.  A null text counts as empty (0 bytes, 0
    tokens); a null id stays null; repeated rows give repeated rows; an empty table gives none;
    texts of any length are counted whole; columns other than the two named are not read.
    """

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        vocab = bpe.load(tokenizer)
        for part in slices(batches):
            text = pc.fill_null(part.column("text"), "")
            counts = bpe.count_texts(vocab, text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = map_texts(id_and_text(df, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
