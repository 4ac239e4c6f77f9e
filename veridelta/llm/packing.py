"""Operator 9: vector bin packing by the dot-product heuristic.

An example has three sizes: tokens, segments and loss-bearing tokens. A sequence has a limit on each. Sequences are
filled one at a time: of the examples that still fit, the one whose sizes have the largest dot product with what is left
of the limits is placed next. Examples are dealt into pools of bounded size by a hash of their own number, and each pool
is packed by one task; examples of equal sizes are interchangeable, so a pool is packed by its distinct sizes.

For documents, a text's ids with an end id are cut into pieces of the sequence length; a full piece is a sequence by
itself, the rest is packed. A null or empty text is its end id alone. Rows that repeat are packed each for itself. An
example that is larger than a limit is an error in ``pack`` and can't arise from documents. An empty table gives no rows;
only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.byteids import byte_ids, vocabulary
from veridelta.llm.common import given_back, read, slices, small_batches, written

END_ID = 1
#: Examples of a pool, on average.
POOL = 50_000


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each example, and the tokens before it there. ``sizes``: tokens, segments, loss by row."""
    if len(sizes) and (sizes > limits).any():
        raise ValueError("an example is larger than a sequence may be")
    classes, of = np.unique(sizes, axis=0, return_inverse=True)
    of = of.reshape(-1)
    waiting = np.bincount(of, minlength=len(classes))
    members = np.argsort(of, kind="stable")
    next_member = np.cumsum(waiting) - waiting
    share = classes / np.maximum(limits, 1)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at, done = 0, 0
    left, used = limits.astype(float), 0
    while done < len(sizes):
        fits = (waiting > 0) & (classes <= left).all(1)
        if not fits.any():
            at, left, used = at + 1, limits.astype(float), 0
            continue
        gain = np.where(fits, share @ (left / np.maximum(limits, 1)), -1.0)
        c = int(gain.argmax())
        example = members[next_member[c]]
        next_member[c] += 1
        waiting[c] -= 1
        bins[example], offsets[example] = at, used
        left, used, done = left - classes[c], used + int(classes[c][0]), done + 1
        if waiting[c] == 0 and len(classes) > 64 and (waiting == 0).mean() > 0.5:
            keep = waiting > 0
            classes, share, waiting, next_member = classes[keep], share[keep], waiting[keep], next_member[keep]
    return bins, offsets


def pack(items: DataFrame, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """``items`` (item long, tokens, segments, loss) with sequence_id and offset.

    ``item`` must be unique; more columns are kept. The rows are counted first, for the number of pools."""
    pools = max(1, -(-items.count() // pool))
    schema = items.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    most = np.array([limits.tokens, limits.segments, limits.loss])

    def one(key, table):
        sizes = np.column_stack([table[n].to_numpy() for n in ("tokens", "segments", "loss")]).astype(np.int64)
        order = np.argsort(table["item"].to_numpy(), kind="stable")  # as dealt, whatever order rows arrive in
        bins, offsets = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        bins[order], offsets[order] = dot_product_bins(sizes[order], most)
        pool_no = key[0].as_py()
        table = table.drop_columns(["pool"])
        return table.append_column("sequence_id", pa.array((pool_no << 32) + bins)).append_column(
            "offset", pa.array(offsets)
        )

    dealt = items.withColumn("pool", F.pmod(F.xxhash64("item"), F.lit(pools)))
    return dealt.groupBy("pool").applyInArrow(one, schema)


def _pieces(path: str, end_id: int, length: int):
    """(doc_id, text) to pieces of at most ``length`` ids, numbered over all tasks."""

    def pieces(batches):
        number = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                rows = []
                for doc_id, found in zip(
                    batch.column("doc_id").slice(at, len(texts)).to_pylist(), byte_ids(path).encode(texts)
                ):
                    found += end
                    n = len(found) // 4
                    for start in range(0, n, length):
                        part = found[4 * start : 4 * (start + length)]
                        rows.append((number, doc_id, start, len(part) // 4, zlib.crc32(part), n))
                        number += 1
                names = ("item", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document's ids: where it comes from, and where in which sequence it is."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written once: the pieces' numbers must stay as they are while they are counted and packed
    found = written(
        rows.mapInArrow(
            given_back(_pieces(tokenizer, end_id, limits.tokens), keeps=True),
            "item long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
        ),
        "pieces",
    )
    full = found.where(F.col("length") == limits.tokens)
    alone = full.withColumn("sequence_id", F.col("item").bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0))
    # an example's first token is predicted from nothing and bears no loss
    rest = found.where(F.col("length") < limits.tokens)
    sized = rest.withColumns(
        {"tokens": F.col("length"), "segments": F.lit(1).cast("long"), "loss": F.col("length") - 1}
    )
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    together = alone.select(*columns).unionByName(pack(sized, limits).select(*columns))
    return together.withColumn("offset", F.col("offset").cast("long"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences; the last stage of the pipeline."""
    small_batches(spark)
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))
