"""Operator 4: token ids in files of directly addressable codes.

A file row is a block of whole documents. Its ids are cut into chunks of 8 bits: level 0 holds the lowest chunk of every
id, level 1 the next chunk of those ids that have one, and so on. Each level has a bitmap that says which of its ids go
on, and a directory of ranks, so that any token is read by one lookup per level, without decoding the block. Blocks are
Parquet rows (written and read by Spark, so any store will do): shard, block, start in the shard, doc_ids, doc_starts,
n_tokens, payload. A manifest beside them has the number of ids before each shard.

Ids are in ascending doc_id order: null ids first, rows with one id by their text. A null text is empty: it has its end
id alone. A document is never cut, so a block is as large as ``BLOCK`` ids or its one longer document. An empty table
gives empty files. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.llm.byteids import byte_ids, vocabulary
from veridelta.llm.common import read, shared_dir, slices, whole_text

#: Ids that a block is closed at.
BLOCK = 1 << 17
#: Bits of a bitmap between two entries of its rank directory.
STRIDE = 512
END_ID = 2
FILE = (
    "shard long, block long, start long, doc_ids array<long>, doc_starts array<long>, n_tokens long, payload binary"
)


def encode(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as directly addressable codes."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little").tobytes()
        counts = np.add.reduceat(more, np.arange(0, len(more), STRIDE)) if len(more) else np.zeros(0, int)
        ranks = (np.cumsum(counts) - counts).astype("<u4").tobytes()
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits, ranks))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack(f"<B{len(levels)}I", len(levels), *(n for n, *_ in levels))
    return head + b"".join(part for _, *parts in levels for part in parts)


class Codes:
    """A payload opened for reading; nothing is decoded until asked for."""

    def __init__(self, payload: bytes):
        count = payload[0]
        sizes = struct.unpack_from(f"<{count}I", payload, 1)
        at, self.levels = 1 + 4 * count, []
        for n in sizes:
            parts = []
            for size, kind in ((n, np.uint8), ((n + 7) // 8, np.uint8), (-(-n // STRIDE) * 4, "<u4")):
                parts.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, positions) -> np.ndarray:
        """The ids at some positions, by one rank lookup a level."""
        where = np.asarray(positions, np.int64)
        out, live = np.zeros(len(where), np.uint32), np.arange(len(where))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[live] |= chunks[where].astype(np.uint32) << (8 * level)
            goes_on = (bits[where >> 3] >> (where & 7) & 1).astype(bool)
            live, where = live[goes_on], where[goes_on]
            if not len(live):
                break
            # rank: the directory's entry, and the bits between it and the place
            first = where // STRIDE * (STRIDE // 8)
            window = bits[np.minimum(first[:, None] + np.arange(STRIDE // 8), len(bits) - 1)]
            spread = np.unpackbits(window, axis=1, bitorder="little")
            before = np.arange(STRIDE) < (where % STRIDE)[:, None]
            where = ranks[where // STRIDE].astype(np.int64) + (spread * before).sum(1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every id in order."""
        out = self.levels[0][0].astype(np.uint32)
        live = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self.levels[:-1]):
            live = live[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
            out[live] |= self.levels[level + 1][0].astype(np.uint32) << (8 * (level + 1))
        return out


def _blocks(path: str, end_id: int):
    """Sorted (doc_id, text) rows to blocks; starts count from the task's first id."""

    def blocks(batches):
        shard, block, start, ids, starts, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int64()),
                    "block": pa.array([block], pa.int64()),
                    "start": pa.array([start], pa.int64()),
                    "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "doc_starts": pa.array([starts], pa.list_(pa.int64())),
                    "n_tokens": pa.array([size], pa.int64()),
                    "payload": [encode(np.frombuffer(b"".join(parts), "<u4"))],
                }
            )

        for batch in batches:
            for at, texts in slices(batch.column("text")):
                for doc_id, found in zip(
                    batch.column("doc_id").slice(at, len(texts)).to_pylist(), byte_ids(path).encode(texts)
                ):
                    ids.append(doc_id)
                    starts.append(start + size)
                    parts += [found, end]
                    size += len(found) // 4 + 1
                    if size >= BLOCK:
                        yield row()
                        block, start, ids, starts, parts, size = block + 1, start + size, [], [], [], 0
        if ids:
            yield row()

    return blocks


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """The documents' ids as files in ``folder``: blocks, and the manifest of shards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # an id with very many rows is dealt out by its texts
    key = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key, "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id), FILE).write.parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    totals = spark.read.schema(FILE).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row for each written shard
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start")).write.parquet(f"{folder}/manifest")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files, with the number of ids before their shard."""
    manifest = spark.read.schema("shard long, shard_start long").parquet(f"{folder}/manifest")
    return spark.read.schema(FILE).parquet(f"{folder}/blocks").join(manifest, "shard")


def tokens_at(spark: SparkSession, folder: str, positions: list[int]) -> DataFrame:
    """(position, token) for a list of places in the whole file.

    The manifest says which shard holds a place, and its number there: only those shards' files are read, and of them the
    parts whose blocks begin no later than the last place asked for. A place outside the file has no row."""
    rows = spark.read.schema("shard long, shard_start long").parquet(f"{folder}/manifest").orderBy("shard").collect()
    if not rows or not positions:
        return spark.createDataFrame([], "position long, token long")
    starts = np.array([r.shard_start for r in rows])
    at = np.searchsorted(starts, np.array(positions), "right") - 1
    asked = [(rows[i].shard, p - rows[i].shard_start, p) for i, p in zip(at.tolist(), positions) if i >= 0]
    last: dict[int, int] = {}
    for shard, local, _ in asked:
        last[shard] = max(last.get(shard, 0), local)
    kept = F.col("shard").isin(sorted(last)) & (F.col("start") <= max(last.values(), default=-1))
    wanted = spark.createDataFrame(asked, "in_shard long, local long, position long")
    inside = (F.col("in_shard") == F.col("shard")) & (F.col("local") >= F.col("start"))
    inside &= F.col("local") < F.col("start") + F.col("n_tokens")
    blocks_ = spark.read.schema(FILE).parquet(f"{folder}/blocks").where(kept).select("shard", "start", "n_tokens", "payload")
    # as many rows as places are asked for
    found = blocks_.join(F.broadcast(wanted), inside).select("payload", (F.col("local") - F.col("start")).alias("place"), "position")

    def look(batches):
        for batch in batches:
            tokens = [int(Codes(p).at([i])[0]) for p, i in zip(*(batch.column(n).to_pylist() for n in ("payload", "place")))]
            yield pa.RecordBatch.from_pydict({"position": batch.column("position"), "token": pa.array(tokens, pa.int64())})

    return found.mapInArrow(look, "position long, token long")


def _digests(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("doc_ids", "doc_starts", "start", "shard_start")}
            ids = Codes(batch.column("payload")[i].as_py()).all().astype("<u4")
            starts = np.array(row["doc_starts"], np.int64) - row["start"]
            ends = np.append(starts[1:], len(ids))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["start"] + row["shard_start"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                }
            )


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, as read back from the files."""
    import uuid

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    rows = blocks(spark, folder).select("doc_ids", "doc_starts", "start", "shard_start", "payload")
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
