"""Ranks and running sums inside groups of any size, without a task that holds a whole group.

Rows are dealt out by ranges of group and order, so a large group lies in consecutive partitions.
Each task counts on its own; only what stands at the two ends of each partition meets on the
driver (two rows for each task), which tells every task what came before its first group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from ..plans import scratch
from .common import tidied


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 1, inside the group) and, for each long column of ``sums``, ``<c>_before`` and ``<c>_through``.

    The sums run in the order of the rank, without and with the row, modulo 2^64.  Nulls are a group of
    their own and come first; rows that tie in everything are ranked in any order; no ``group`` ranks
    the whole table; an empty table gives none.  ``df`` should be a written table, as it is read twice.
    """
    import numpy as np

    spark = df.sparkSession
    scratch.ship(spark)
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    # equal rows are told apart by where they are read, so they can be dealt out too
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    names, group, sums = list(df.columns), list(group), list(sums)
    added = ["rank"] + [f"{c}_{side}" for c in sums for side in ("before", "through")]
    schema = StructType(list(df.schema.fields))
    for name in added:
        schema = schema.add(name, LongType())
    edged = StructType(list(schema.fields)).add("_task", IntegerType()).add("_head", BooleanType()).add("_edge", IntegerType())

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, held, ahead, carry, in_head, any_rows = TaskContext.get().partitionId(), None, None, [0] * (1 + len(sums)), True, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in group:
                a, b = batch.column(c).slice(0, n - 1), batch.column(c).slice(1)
                differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            first = [batch.column(c)[0].as_py() for c in group]
            new[0] = any_rows and first != held
            held = [batch.column(c)[n - 1].as_py() for c in group]
            starts = np.flatnonzero(new | (np.arange(n) == 0))
            of = np.cumsum(new | (np.arange(n) == 0)) - 1
            columns = {c: batch.column(c) for c in names}
            values = [np.ones(n, np.uint64)] + [batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in sums]
            for i, v in enumerate(values):
                through = np.cumsum(v, dtype=np.uint64)
                base = (through - v)[starts]
                if not new[0]:
                    base[:1] -= np.array([carry[i]], np.uint64)
                through -= base[of]
                carry[i] = int(through[-1])
                if i:
                    columns[f"{sums[i - 1]}_before"] = pa.array((through - v).view(np.int64))
                    columns[f"{sums[i - 1]}_through"] = pa.array(through.view(np.int64))
                else:
                    columns["rank"] = pa.array(through.view(np.int64))
            head = in_head & (np.cumsum(new) == 0)
            in_head = bool(head[-1])
            edge = np.zeros(n, np.int32)
            edge[0] = 0 if any_rows else 1
            any_rows = True
            columns |= {"_task": pa.array(np.full(n, task, np.int32)), "_head": pa.array(head), "_edge": edge}
            if ahead is not None:
                yield pa.RecordBatch.from_pydict(ahead | {"_edge": pa.array(ahead["_edge"])})
            ahead = columns
        if ahead is not None:
            ahead["_edge"][-1] += 2
            yield pa.RecordBatch.from_pydict(ahead | {"_edge": pa.array(ahead["_edge"])})

    counted = scratch.materialise(dealt.mapInArrow(tidied(work), edged), "running")
    totals = ["rank"] + [f"{c}_through" for c in sums]
    # two rows for each task
    edges = counted.where("_edge > 0").select("_task", "_edge", *group, *totals).collect()
    heads, tails = {r["_task"]: r for r in edges if r["_edge"] & 1}, {r["_task"]: r for r in edges if r["_edge"] & 2}
    before, key, held = {}, None, [0] * len(totals)
    for task in sorted(heads):
        head, tail = tuple(heads[task][c] for c in group), tuple(tails[task][c] for c in group)
        start = held if head == key else [0] * len(totals)
        if any(start):
            before[task] = start
        held = [((s if head == tail else 0) + tail_sum) % 2**64 for s, tail_sum in zip(start, (tails[task][c] for c in totals), strict=True)]
        key = tail
    if not before:
        return counted.select(*names, *added)
    sent = spark.sparkContext.broadcast(before)

    def add(batches):
        import pyarrow as pa

        nothing = [0] * len(totals)
        for batch in batches:
            tasks, head = batch.column("_task").to_numpy(), batch.column("_head").to_numpy(zero_copy_only=False)
            columns = {c: batch.column(c) for c in names}
            for i, c in enumerate(totals):
                present, where = np.unique(tasks, return_inverse=True)
                plus = np.array([sent.value.get(int(t), nothing)[i] for t in present], np.uint64)[where] * head
                for name in [c] if not i else [f"{sums[i - 1]}_before", c]:
                    columns[name] = pa.array((batch.column(name).to_numpy().astype(np.int64).view(np.uint64) + plus).view(np.int64))
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in (*names, *added)})

    return counted.mapInArrow(tidied(add), schema)
