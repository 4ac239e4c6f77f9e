"""Operator 11: exact duplicates by an exchange of Golomb-coded fingerprints.

Every task hashes its texts and sends each owner of a range of hashes its distinct ones: sorted, as gaps in Golomb codes
(unary quotients and fixed remainders, the divisor a power of two near 0.69 of the mean gap). Owners compare the lists and
answer each with a bitmap of the hashes that another list has too. Only rows whose hash is marked, or repeats in its own
list, are suspects: their texts alone are shuffled and compared byte by byte, after equal texts of a task are put together.

Hashes are as long as the number of rows asks for, so that about one row in a thousand is a suspect for nothing; texts are
compared, so that never changes the result. What is kept between the two reads of the texts is a row's id, hash and SHA-256.

A null text is empty, and equal to other empty ones. Rows without a doc_id take part; a group in which no row has one has a
null keep_id and keeps its rows. Rows that share the id that stays all stay: nothing tells them apart. An empty table gives no
rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import read, whole_text, written

#: Rows of one list at most; fingerprints that an owner compares, on average; owners at least.
LIST, OWNED, LEAST_OWNERS = 1 << 17, 1 << 22, 32
#: Bits of a fingerprint beyond those that number the rows.
SPARE_BITS = 10
#: Rows that are broadcast at most (under 100 bytes each); beyond it joins shuffle both sides.
MOST_BROADCAST = 500_000
SENT = (
    "sender long, owner long, payload binary, fps array<long>, rows array<int>, doc_ids array<long>, shas array<binary>"
)


def golomb(gaps: np.ndarray, span: int) -> bytes:
    """Non-negative gaps, whose sum is under ``span``, as Golomb codes."""
    n = len(gaps)
    gaps = gaps.astype(np.uint64)
    k = max(0, int(0.69 * span / max(n, 1)).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    places = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IIB", n, len(unary), k) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def ungolomb(payload: bytes) -> np.ndarray:
    """The gaps again, as unsigned 64-bit numbers."""
    n, long, k = struct.unpack_from("<IIB", payload)
    middle = 9 + (long + 7) // 8
    unary = np.unpackbits(np.frombuffer(payload, np.uint8, middle - 9, 9), count=long)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(payload, np.uint8, offset=middle), count=n * k).reshape(n, k).astype(np.uint64)
    low = (rest << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(k)) | low


def normalised() -> Column:
    """The whole text, each run of white space one space."""
    text = whole_text()
    odd = text.rlike(r"[\x09-\x0D]|\x20\x20")
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text)


def _lists(bits: int, owner_bits: int):
    """(doc_id, fp, sha) rows to one row for each list of a task and owner that it has fingerprints for."""
    span = 1 << (bits - owner_bits)

    def rows(sender: int, batches: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        fps = table["fp"].to_numpy()
        order = np.argsort(fps, kind="stable")
        distinct, first, times = np.unique(fps[order], return_index=True, return_counts=True)
        owners = distinct >> (bits - owner_bits)
        cuts = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(distinct))
        payloads = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            payloads.append(golomb(np.diff(distinct[a:b], prepend=int(owners[a]) * span), span))
        by_fp = pa.array(cuts, pa.int32())
        by_row = pa.array(np.append(first, len(order))[cuts], pa.int32())
        sorted_rows = table.take(pa.array(order))
        columns = {
            "sender": pa.array([sender] * len(payloads), pa.int64()),
            "owner": pa.array(owners[cuts[:-1]], pa.int64()),
            "payload": pa.array(payloads, pa.binary()),
            "fps": pa.ListArray.from_arrays(by_fp, pa.array(distinct, pa.int64())),
            "rows": pa.ListArray.from_arrays(by_fp, pa.array(times, pa.int32())),
            "doc_ids": pa.ListArray.from_arrays(by_row, sorted_rows["doc_id"].combine_chunks()),
            "shas": pa.ListArray.from_arrays(by_row, sorted_rows["sha"].combine_chunks()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def lists(batches):
        sender, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LIST:
                yield rows(sender, held)
                sender, held, size = sender + 1, [], 0
        if size:
            yield rows(sender, held)

    return lists


def _answers(key, table):
    """An owner's answer to each list: a bit for every fingerprint that another list has too."""
    lists = [np.cumsum(ungolomb(p.as_py())) for p in table["payload"]]
    ends = np.cumsum([len(x) for x in lists])
    together = np.concatenate(lists)
    order = np.argsort(together, kind="stable")
    same = together[order][1:] == together[order][:-1]
    twice = np.zeros(len(together), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    answers = [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])]
    return pa.table({"sender": table["sender"], "owner": table["owner"], "marks": pa.array(answers, pa.binary())})


def _marked(batches):
    """Lists with their answers to rows (doc_id, fp, sha, suspect)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            fps, times = (row.column(n).flatten().to_numpy() for n in ("fps", "rows"))
            marks = np.unpackbits(np.frombuffer(row.column("marks")[0].as_py(), np.uint8), count=len(fps)).astype(bool)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": row.column("doc_ids").flatten(),
                    "fp": pa.array(np.repeat(fps, times), pa.int64()),
                    "sha": row.column("shas").flatten(),
                    "suspect": pa.array(np.repeat(marks | (times > 1), times)),
                }
            )


def _held_against(rows: DataFrame, other: DataFrame, keys: list[str], how: str, most_broadcast: int) -> DataFrame:
    """``rows`` joined with ``other``, whose rows are distinct by ``keys``.

    Beyond the bound both sides are dealt out for the join alone (the last key says nothing new), which adaptive execution
    splits where one key has very many rows."""
    if other.count() <= most_broadcast:
        return rows.join(F.broadcast(other), keys, how)
    dealt = [df.withColumn("dealt", F.xxhash64(*keys)) for df in (rows, other)]
    return dealt[0].join(dealt[1], [*keys, "dealt"], how).drop("dealt")


def duplicates(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. The rows are counted first."""
    count = docs.count()
    owner_bits = (max(LEAST_OWNERS, -(-count // OWNED)) - 1).bit_length()
    bits = min(62, max(owner_bits + 8, count.bit_length() + SPARE_BITS))
    fp = F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("fp", fp)
    hashed = texts.select("doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha"))
    sent = written(hashed.mapInArrow(_lists(bits, owner_bits), SENT), "sent")
    answers = (
        sent.select("sender", "owner", "payload").groupBy("owner").applyInArrow(_answers, "sender long, owner long, marks binary")
    )
    lists = sent.select("sender", "owner", "fps", "rows", "doc_ids", "shas").join(answers, ["sender", "owner"])
    marked = lists.mapInArrow(_marked, "doc_id long, fp long, sha binary, suspect boolean")
    marked = written(marked, "marked")
    suspects = marked.where("suspect")
    wanted = suspects.select("fp").distinct()
    compared = _held_against(texts, wanted, ["fp"], "left_semi", most_broadcast)
    # grouping by the text compares its bytes; a task's equal texts are one row before they travel
    classes = compared.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = written(
        classes.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "classes"
    )
    columns = ("doc_id", "sha", "keep_id", "group_size")
    found = _held_against(suspects, classes, ["fp", "sha"], "inner", most_broadcast).select(*columns)
    alone = marked.where("not suspect").select(
        "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return found.unionByName(alone).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op11_exact(spark, sf_dir: str) -> DataFrame:
    """Every document with the equal one that stays."""
    return duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
