"""Lexical and dense retrieval, their evaluation, and sampling of retrieved contexts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veridelta.functions.layout import query_of_claims
from veridelta.functions.text import TOKEN, tokens, uniform, word_runs
from veridelta.session import written

# The usual saturation and length constants, and the share of the mean idf that negative ones get.
K1, B, FLOOR = 1.5, 0.75, 0.25


#: Rows of a side that are broadcast at most; beyond it the join is a shuffled one.
MOST_BROADCAST = 300_000
#: Queries and items that meet in one task, at most; numbers that a side's vectors have there, and items of a cell.
TILE_QUERIES, TILE_ITEMS, TILE_NUMBERS, CELL = 16_384, 262_144, 1 << 22, 256
#: Queries and items of a tile that is made smaller for want of tasks, at least.
LEAST_QUERIES, LEAST_ITEMS = 64, 65_536
MOST_PARTITIONS = 2000
#: Queries scored with a cell at once, so that their scores stay in a core's cache; cells that a query looks at first.
TOGETHER, FIRST_CELLS = 1024, 3
#: Half of the last place of a rounded score, and what floating-point angles may be wrong by.
HALF, SLACK = 0.5e-6 + 1e-12, 1e-6


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if it is no larger than ``MOST_BROADCAST`` rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _indexed(kinds: dict[str, str]):
    """Batches of (doc, chunk, text) to the terms of each text with their numbers; nothing leaves the row."""
    token, posting = re.compile(TOKEN), pa.struct([("term", pa.string()), ("tf", pa.int32())])

    def indexed(batches):
        for batch in batches:
            lengths, ends, terms, numbers = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = token.findall(text or "")
                own = Counter(map(str.lower, found))
                terms += own.keys()
                numbers += own.values()
                lengths.append(len(found))
                ends.append(len(terms))
            both = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int32())], fields=list(posting))
            columns = {n: batch.column(n) for n in kinds}
            yield pa.RecordBatch.from_pydict(
                columns | {"dl": pa.array(lengths, pa.int32()), "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)}
            )

    return indexed


def term_index(chunks: DataFrame, chunk: str, doc: str, text: str, title: str | None = None) -> DataFrame:
    """(doc, chunk, dl, postings): each chunk's length and its terms with their numbers. A title counts as text before it.

    Terms are counted in Arrow batches, a third of the time that array functions take for it."""
    body = F.concat_ws(" ", F.col(title), F.col(text)) if title else F.col(text)
    own = chunks.select(F.col(doc).alias("doc"), F.col(chunk).alias("chunk"), body.alias("text"))
    kinds = {n: kind for n, kind in own.dtypes if n != "text"}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", dl int, postings array<struct<term: string, tf: int>>"
    return own.mapInArrow(_indexed(kinds), schema)


def contiguous(chunks: DataFrame, chunk: str, doc: str) -> DataFrame:
    """``chunks`` if each document's are numbered from 0 without a gap."""
    own = chunks.groupBy(doc).agg(F.count("*").alias("n"), F.count_distinct(chunk).alias("m"), F.min(chunk).alias("a"), F.max(chunk).alias("b"))
    if not own.where("n <> m or a <> 0 or b <> n - 1").isEmpty():
        raise ValueError("a document's chunks aren't numbered from 0 without a gap")
    return chunks


#: Terms of queries in chunks that are weighed at once, and scores that are held at once.
MOST_MET, MOST_SCORES = 1 << 20, 1 << 21


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """Of (q, doc, chunk, score) each q's k best documents: the largest score, then the lesser document, by its best chunk."""

    def new(t: pa.Table, *names: str) -> np.ndarray:
        codes = [t[n].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for n in names]
        return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in codes]))

    if not len(found):
        return found
    own = found.sort_by([("q", "ascending"), ("doc", "ascending"), ("score", "descending"), ("chunk", "ascending")])
    own = own.filter(pa.array(new(own, "q", "doc")))
    order = pc.sort_indices(own, [("q", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start")
    own = own.take(order)
    first = new(own, "q")
    place = np.arange(len(own))
    return own.filter(pa.array(place - np.maximum.accumulate(np.where(first, place, 0)) < k))


def _task_best(asked: pa.Table, kinds: dict[str, pa.DataType], k: int):
    """Batches of a term index to the k best documents of each query among a task's chunks.

    A document that is among all the k best is so too where its best chunk is, so nothing else need leave the task."""
    coded = asked["query"].combine_chunks().dictionary_encode()
    names, n_asked = coded.dictionary, len(coded.dictionary)
    listed = asked["term"].combine_chunks().dictionary_encode()
    terms, mean = listed.dictionary, asked["mean"][0].as_py()
    order = np.argsort(listed.indices.to_numpy(), kind="stable")
    of_query, weight = coded.indices.to_numpy()[order], asked["weight"].to_numpy()[order]
    n_of = np.bincount(listed.indices.to_numpy(), minlength=len(terms))
    begin = np.cumsum(n_of) - n_of
    schema = pa.schema([("q", pa.int32()), ("doc", kinds["doc"]), ("chunk", kinds["chunk"]), ("score", pa.float64())])

    def scores(rows: int, row, slot, tf, length):
        """The rounded scores of each row and query, -inf where they have no term in common."""
        n = n_of[slot]
        at = np.repeat(begin[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part = tf * (K1 + 1) / (tf + K1 * length[row])
        cell = np.repeat(row * n_asked, n) + of_query[at]
        total = np.bincount(cell, weights=weight[at] * np.repeat(part, n), minlength=rows * n_asked)
        total = np.trunc(total * 1e6 + np.copysign(0.5, total)) / 1e6
        total[np.bincount(cell, minlength=rows * n_asked) == 0] = -np.inf
        return total.reshape(rows, n_asked)

    def tiles(batch: pa.RecordBatch):
        """Rows, by document and chunk, with the scores of so many at once that both bounds hold."""
        order = pc.sort_indices(batch, [("doc", "ascending"), ("chunk", "ascending")], null_placement="at_start")
        batch = batch.take(order)
        lists = batch.column("postings")
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        held = lists.flatten()
        slot = pc.index_in(held.field("term"), value_set=terms)
        known = slot.is_valid().to_numpy(zero_copy_only=False)
        slot, row = slot.drop_null().to_numpy(), row[known]
        tf = held.field("tf").to_numpy(zero_copy_only=False)[known].astype(float)
        length = 1 - B + B * batch.column("dl").to_numpy() / mean
        met = np.cumsum(np.bincount(row, weights=n_of[slot], minlength=len(batch)))
        at = 0
        while at < len(batch):
            most = met[at - 1] + MOST_MET if at else MOST_MET
            end = min(max(at + 1, int(np.searchsorted(met, most, "right"))), at + max(1, MOST_SCORES // n_asked))
            low, high = np.searchsorted(row, [at, end])
            yield batch.slice(at, end - at), scores(end - at, row[low:high] - at, slot[low:high], tf[low:high], length[at:end])
            at = end

    def best(batches):
        found, waiting, least = schema.empty_table(), [], np.full(n_asked, -np.inf)

        def merged():
            both = _k_best(pa.concat_tables([found, *waiting]), k)
            waiting.clear()
            q = both["q"].to_numpy()
            n = np.bincount(q, minlength=n_asked)
            low = np.full(n_asked, np.inf)
            np.minimum.at(low, q, both["score"].to_numpy())
            return both, np.where(n >= k, low, -np.inf)

        for batch in batches:
            for rows, score in tiles(batch) if len(batch) else ():
                docs = rows.column("doc").dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts = np.nonzero(np.append(True, docs[1:] != docs[:-1]))[0]
                of_doc = np.maximum.reduceat(score, starts)
                bar = least
                if len(starts) > k:
                    bar = np.maximum(bar, np.partition(of_doc, len(starts) - k, axis=0)[len(starts) - k])
                q, d = np.nonzero(((of_doc >= bar) & (of_doc > -np.inf)).T)
                value = of_doc[d, q]
                # documents in order within a query and score: of many ties the first k
                order = np.lexsort((d, -value, q))
                q, d, value = q[order], d[order], value[order]
                head = np.searchsorted(q, q)
                q, d, value = (x[np.arange(len(head)) - head < k] for x in (q, d, value))
                if not len(q):
                    continue
                ends = np.append(starts[1:], len(rows))
                # a document's first chunk with its score
                at = [a + int((score[a:b, i] == v).argmax()) for a, b, i, v in zip(starts[d], ends[d], q, value)]
                part = rows.select(["doc", "chunk"]).take(pa.array(at))
                waiting.append(pa.table([pa.array(q, pa.int32()), part.column("doc"), part.column("chunk"), pa.array(value)], schema=schema))
                if sum(map(len, waiting)) > max(4096, len(found)):
                    found, least = merged()
        found, _ = merged()
        out = pa.table([names.take(found["q"].combine_chunks()), *found.columns[1:]], names=["query", "doc", "chunk", "score"])
        yield from out.combine_chunks().to_batches()

    return best


def _weighed(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, doc, chunk, score): chunks of ``index`` with their scores, among them each query's k best documents' best ones.

    Terms of queries that are few go to every task, which sends each query's best only; else they are joined."""
    if asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        held = asked.toArrow()
        kinds = dict(index.dtypes)
        schema = f"query {dict(asked.dtypes)['query']}, doc {kinds['doc']}, chunk {kinds['chunk']}, score double"
        if not len(held):
            return index.sparkSession.createDataFrame([], schema)
        own = index.select("doc", "chunk", "dl", "postings")
        arrow = {n: to_arrow_type(own.schema[n].dataType) for n in ("doc", "chunk")}
        shared = index.sparkSession.sparkContext.broadcast(held)
        return own.mapInArrow(lambda batches: _task_best(shared.value, arrow, k)(batches), schema)
    length = 1 - B + B * F.col("dl") / F.col("mean")
    exploded = index.select("doc", "chunk", "dl", F.explode("postings").alias("p"))
    met = exploded.select("doc", "chunk", "dl", F.col("p.term").alias("term"), F.col("p.tf").alias("tf")).join(asked, "term")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return met.groupBy("query", "doc", "chunk").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(
    queries: DataFrame, chunks: DataFrame, query: str, query_text: str, doc: str, chunk: str, text: str, k: int, title: str | None = None
) -> DataFrame:
    """(query, rank, doc, chunk, score): each query's k best documents, a document by its best chunk.

    Chunks are numbered within their document from 0 without a gap, or it is an error; the best is the lowest one of the largest
    score. Scores are rounded to 6 digits before they are ranked; ties go to the lesser document. Documents without a common term follow, least first,
    where fewer than k have one; a query without terms has no rows. Texts are cut into terms once, and the index is written;
    only terms of some query are weighed, and of a task's chunks only each query's k best documents are shuffled."""
    index = written(term_index(chunks, chunk, doc, text, title), "index")
    contiguous(index, "chunk", "doc")
    sizes = index.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    exploded = index.select("doc", "chunk", "dl", F.explode("postings").alias("p"))
    frequency = exploded.groupBy(F.col("p.term").alias("term")).agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # one row of corpus figures
    idf = frequency.crossJoin(F.broadcast(sizes)).withColumn("raw", raw).select("term", "mean", "raw")
    idf = written(idf, "idf")
    floor = idf.agg((F.avg("raw") * FLOOR).alias("floor"))
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query", "term").agg(F.count("*").alias("qf"))
    wanted = idf.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(floor))
    wanted = wanted.select("term", "mean", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    asked = written(asked.join(wanted, "term").select("query", "term", "mean", (F.col("qf") * F.col("idf")).alias("weight")), "asked")
    scored = _weighed(index, asked, k)
    # a document's best chunk: largest score, then lowest number; partial on the map side
    best = scored.groupBy("query", "doc").agg(F.max(F.struct("score", (-F.col("chunk")).alias("c"))).alias("b"))
    best = best.select("query", "doc", (-F.col("b.c")).alias("chunk"), F.col("b.score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = written(top.select("query", "rank", "doc", "chunk", "score"), "top")
    few = asked.select("query").distinct().join(top.groupBy("query").agg(F.count("*").alias("found")), "query", "left")
    few = few.select("query", F.coalesce("found", F.lit(0)).alias("found")).where(F.col("found") < k)
    # the first 2k documents hold enough that have no common term: at most k of them are found already
    spare = index.groupBy("doc").agg(F.min("chunk").alias("chunk")).orderBy("doc").limit(2 * k)
    rest = few.crossJoin(F.broadcast(spare)).join(top.select("query", "doc"), ["query", "doc"], "left_anti")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("doc")) + F.col("found"))
    rest = rest.where(F.col("place") <= k).select("query", F.col("place").alias("rank"), "doc", "chunk", F.lit(0.0).alias("score"))
    return top.unionByName(rest)


def shared_runs(texts: DataFrame, key: str, text: str, wanted: DataFrame, n: int) -> DataFrame:
    """(key, run): each text's runs of n words, once, that are among ``wanted`` (run).

    Runs that are few go to every task, where a text's own are looked up and never leave it; else they are joined."""
    if wanted.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        own = texts.select(key, F.explode(word_runs(F.col(text), n)).alias("run"))
        return own.distinct().join(wanted.select("run").distinct(), "run", "left_semi").select(key, "run")
    own = texts.select(key, F.col(text).alias("text"))
    runs = set(wanted.select("run").toArrow()["run"].to_pylist())
    shared = texts.sparkSession.sparkContext.broadcast((runs, {r.split(" ", 1)[0] for r in runs}))

    def found(batches):
        known, heads = shared.value
        for batch in batches:
            at, met = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").split()
                said = {" ".join(words[j : j + n]) for j in range(len(words) - n + 1) if words[j] in heads}
                both = sorted(said & known)
                at += [i] * len(both)
                met += both
            yield pa.RecordBatch.from_pydict({key: batch.column(key).take(pa.array(at, pa.int64())), "run": pa.array(met, pa.string())})

    return own.mapInArrow(found, f"{key} {dict(own.dtypes)[key]}, run string")


def unit(vector: Column) -> Column:
    """A vector of length one; zero stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cells(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of unit vectors by cells, where these end, their centres, and the largest angle to a centre."""
    draw = np.random.default_rng(len(own))
    centres = own[draw.choice(len(own), -(-len(own) // CELL), replace=False)]
    for again in (True, False):
        cell = np.concatenate([np.argmax(own[i : i + 4096] @ centres.T, 1) for i in range(0, len(own), 4096)])
        if again:
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, own)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    radius = np.zeros(len(centres))
    np.maximum.at(radius, cell, _angles((own * centres[cell]).sum(1)))
    return np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell, minlength=len(centres))), centres, radius


def _angles(cosines: np.ndarray) -> np.ndarray:
    np.clip(cosines, -1, 1, out=cosines)
    return np.arccos(cosines, out=cosines)


class _Best:
    """Each query's k best (rounded score, rank of an item) so far."""

    def __init__(self, n: int, k: int):
        self.scores, self.ranks, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def better(self, at: np.ndarray, scores: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Where items would be among a query's best."""
        least = self.scores[at, -1]
        return np.flatnonzero((scores > least) | ((scores == least) & (ranks < self.ranks[at, -1])))

    def add(self, at: np.ndarray, scores: np.ndarray, ranks: np.ndarray) -> None:
        own = np.flatnonzero(np.bincount(at))
        at = np.concatenate([np.repeat(own, self.k), at])
        scores, ranks = np.concatenate([self.scores[own].ravel(), scores]), np.concatenate([self.ranks[own].ravel(), ranks])
        order = np.lexsort((ranks, -scores, at))
        first = np.searchsorted(at[order], own)
        order = order[first[:, None] + np.arange(self.k)]
        self.scores[own], self.ranks[own] = scores[order], ranks[order]


def _tile_top(k: int, near: float):
    """A tile of queries and one of items to each query's k best items there.

    Items lie in cells around centres. A query passes over a cell if by the cell's radius nothing there is as good as its k-th
    best so far, or all of it is near to what the query has. Of equal vectors, those of the least numbers are enough."""

    def numbers(lists: pa.Array, rows: int) -> np.ndarray:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(rows, len(flat) // max(rows, 1))

    def top(_, queries: pa.Table, items: pa.Table) -> pa.Table:
        kinds = {"query": queries.schema.field("query").type, "item": items.schema.field("item").type, "score": pa.float64()}
        if not len(queries) or not len(items):
            return pa.table({n: pa.array([], kind) for n, kind in kinds.items()})
        asked, own = (numbers(t[c].combine_chunks(), len(t)) for t, c in ((queries, "q"), (items, "v")))
        ids, rank = np.unique(items["item"].to_numpy(), return_inverse=True)
        had = queries["had"].combine_chunks()
        n_had = pc.fill_null(pc.list_value_length(had), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        had = had.flatten()
        had_ids, had = had.field("i").to_numpy(zero_copy_only=False), numbers(had.field("v"), len(had)).reshape(-1, own.shape[1])
        begin = np.cumsum(n_had) - n_had
        most = int(n_had.max())
        # what a query has, as one number of the query and the item's rank
        place = np.minimum(np.searchsorted(ids, had_ids), len(ids) - 1)
        theirs = (np.repeat(np.arange(len(queries)), n_had) * len(ids) + place)[ids[place] == had_ids]

        real = np.isfinite(own).all(1)
        own, rank = own[real], rank[real]
        _, same = np.unique(own, axis=0, return_inverse=True)
        order = np.lexsort((rank, same))
        run = np.searchsorted(same[order], same[order])
        kept = order[np.arange(len(order)) - run < k + most]
        own, rank = own[kept], rank[kept]
        best = _Best(len(queries), k)
        if len(own):
            order, end, centres, radius = _cells(own)
            own, rank = own[order], rank[order]
            bound = _angles(centres @ asked.T)
            bound -= radius[:, None] + SLACK
            np.cos(np.maximum(bound, 0, out=bound), out=bound)
            limit = np.arccos(max(near, -1)) if near < 1 else -np.inf
            for j in range(most):
                have = np.flatnonzero(n_had > j)
                for i in range(0, len(have), TOGETHER):
                    rows = have[i : i + TOGETHER]
                    inside = _angles(centres @ had[begin[rows] + j].T) + radius[:, None] + SLACK <= limit
                    bound[:, rows] = np.where(inside, -np.inf, bound[:, rows])

            def look(cell: int, who: np.ndarray) -> None:
                low = end[cell - 1] if cell else 0
                there, ranks = own[low : end[cell]].T, rank[low : end[cell]]
                for i in range(0, len(who) if len(ranks) else 0, TOGETHER):
                    rows = who[i : i + TOGETHER]
                    scores = asked[rows] @ there
                    for j in range(most):
                        have = np.flatnonzero(n_had[rows] > j)
                        close = had[begin[rows[have]] + j] @ there >= near
                        if len(have) == len(rows):
                            np.copyto(scores, -np.inf, where=close)
                        else:
                            scores[have] = np.where(close, -np.inf, scores[have])
                    at, column = np.divmod(np.flatnonzero(scores >= np.maximum(best.scores[rows, -1] - HALF, -2)[:, None]), len(ranks))
                    found = np.round(scores[at, column], 6)
                    at, column = rows[at], ranks[column]
                    kept = best.better(at, found, column)
                    kept = kept[~np.isin(at[kept] * len(ids) + column[kept], theirs)] if len(theirs) else kept
                    if len(kept):
                        best.add(at[kept], found[kept], column[kept])

            every = np.arange(len(asked))
            for _ in range(min(FIRST_CELLS, len(centres))):
                cells = bound.argmax(0)
                promised = bound[cells, every]
                bound[cells, every] = -np.inf
                by = np.argsort(cells, kind="stable")
                for who in np.split(by, np.flatnonzero(np.diff(cells[by])) + 1):
                    look(cells[who[0]], who[promised[who] >= np.maximum(best.scores[who, -1] - 2 * HALF, -2)])
            for cell in range(len(centres)):
                look(cell, np.flatnonzero(bound[cell] >= np.maximum(best.scores[:, -1] - 2 * HALF, -2)))
        at, place = np.nonzero(best.scores > -np.inf)
        out = {"query": queries["query"].take(pa.array(at)), "item": pa.array(ids[best.ranks[at, place]]), "score": pa.array(best.scores[at, place])}
        return pa.table({n: out[n].cast(kind) for n, kind in kinds.items()})

    return top


def dense_top_k(
    queries: DataFrame, items: DataFrame, existing: DataFrame, query: str, item: str, vector: str, k: int, near: float = 0.95
) -> DataFrame:
    """(query, rank, item, score): each query's k most similar items by rounded cosine, ties to the lesser item.

    ``existing`` (query, item, vector) are items that a query has: they and what is as similar as ``near`` to one of them
    are skipped. Queries and items are dealt into tiles of bounded size by their numbers; each pair of tiles meets in one task,
    which multiplies what lies close enough together and keeps each query's k best."""
    as_unit = lambda c: unit(F.col(c).cast("array<double>"))
    rows, n_asked = items.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("size")).first(), queries.count()
    tile = lambda most: max(1, min(most, TILE_NUMBERS // max(rows["size"] or 1, 1)))
    n_items, tiles = max(1, -(-rows["n"] // tile(TILE_ITEMS))), max(1, -(-n_asked // tile(TILE_QUERIES)))
    # on little input, smaller tiles, so that every core has its share
    wanted = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n_items = max(n_items, min(rows["n"] // LEAST_ITEMS, wanted // tiles))
    n_asked = max(tiles, min(n_asked // LEAST_QUERIES, wanted // n_items))
    had = existing.select(
        F.col(query).alias("query"), F.struct(F.col(item).alias("i"), as_unit(vector).alias("v")).alias("h")
    )
    had = had.groupBy("query").agg(F.collect_list("h").alias("had"))  # a query's context: a few items
    asked = queries.select(F.col(query).alias("query"), as_unit(vector).alias("q")).join(had, "query", "left")
    own = items.select(F.col(item).alias("item"), as_unit(vector).alias("v"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("one", F.pmod(F.xxhash64("query"), F.lit(n_asked)).cast("int")).withColumn("two", every(n_items))
    own = own.withColumn("two", F.pmod(F.xxhash64("item"), F.lit(n_items)).cast("int")).withColumn("one", every(n_asked))
    kinds = f"query {dict(asked.dtypes)['query']}, item {dict(own.dtypes)['item']}, score double"
    # more partitions than pairs of tiles: two pairs rarely wait for each other
    spread = min(4 * n_asked * n_items, MOST_PARTITIONS)
    asked, own = (df.repartition(spread, "one", "two") for df in (asked, own))
    part = asked.groupBy("one", "two").cogroup(own.groupBy("one", "two")).applyInArrow(_tile_top(k, near), kinds)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "item"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "item", "score")


def claim_queries(claims: DataFrame, query: str, column: str) -> DataFrame:
    """(query, text): the search text of each question's claims; without claims there is none, and nothing is searched."""
    return claims.where(F.size(column) > 0).select(query, query_of_claims(F.col(column)).alias("text"))


def evidence(runs: DataFrame, query: str, gold: str, initial: str, retrieved: str) -> DataFrame:
    """(query, initial_recall, recall, precision, all_found) of arrays of urls, as sets; null where there is no gold.

    What was retrieved counts together with what was there at first."""
    once = lambda c: F.array_distinct(F.coalesce(F.col(c), F.lit([]).cast("array<string>")))
    rows = runs.select(query, once(gold).alias("g"), once(initial).alias("i"), F.array_union(once(retrieved), once(initial)).alias("r"))
    shared = lambda a: F.size(F.array_intersect("g", a)).cast("double")
    known = F.size("g") > 0
    return rows.select(
        query,
        F.when(known, shared("i") / F.size("g")).alias("initial_recall"),
        F.when(known, shared("r") / F.size("g")).alias("recall"),
        F.when(known, F.when(F.size("r") > 0, shared("r") / F.size("r")).otherwise(0.0)).alias("precision"),
        F.when(known, (F.size(F.array_except("g", "r")) == 0).cast("double")).alias("all_found"),
    )


def retrieval_quality(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: mean recall and success at each k, and the mean reciprocal rank at the largest.

    ``ranked`` (query, rank, doc); ``gold`` (query, doc). Queries without gold don't count; one without results scores 0."""
    gold = gold.select("query", "doc").distinct()
    totals = gold.groupBy("query").agg(F.count("*").alias("n_gold"))
    hits = ranked.join(gold, ["query", "doc"], "left_semi").groupBy("query").agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(F.col("rank") <= max(ks), F.col("rank"))).alias("first"),
    )
    own = totals.join(hits, "query", "left")
    n = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return own.agg(
        *[mean(n(k) / F.col("n_gold")).alias(f"recall_{k}") for k in ks],
        *[mean((n(k) > 0).cast("double")).alias(f"success_{k}") for k in ks],
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def retrieval_logits(score: str, by: str, temperature: float = 1.0) -> Column:
    """Standard scores by the population deviation over a temperature; 0 where nothing varies."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd < 1e-12, F.lit(0.0)).otherwise((F.col(score) - F.avg(score).over(w)) / sd / temperature)


def softmax(logit: str, by: str) -> Column:
    w = Window.partitionBy(by)
    shifted = F.exp(F.col(logit) - F.max(logit).over(w))
    return shifted / F.sum(shifted).over(w)


def retrieval_probabilities(df: DataFrame, by: str, score: str, temperature: float = 1.0) -> DataFrame:
    """``df`` with ``logit`` and ``probability``: standard scores of each group over a temperature, and their softmax.

    Groups are aggregated before they are shuffled and their figures joined back, so that a group may hold a large share of all
    rows; the largest logit is that of the largest score. Rows without a group are one; a null score has neither."""
    rows = df.select("*", F.col(by).alias("__by"))
    spread = rows.groupBy(F.col("__by").alias("__g")).agg(
        F.avg(score).alias("__mean"), F.stddev_pop(score).alias("__sd"), F.max(score).alias("__top")
    )

    def standard(value: Column) -> Column:
        flat = F.when(value.isNotNull(), F.lit(0.0))
        return F.when(F.col("__sd") < 1e-12, flat).otherwise((value - F.col("__mean")) / F.col("__sd") / temperature)

    rows = rows.join(spread, F.col("__by").eqNullSafe(F.col("__g"))).drop("__g")
    rows = rows.withColumn("logit", standard(F.col(score)))
    rows = rows.withColumn("__e", F.exp(F.col("logit") - standard(F.col("__top"))))
    total = rows.groupBy(F.col("__by").alias("__g")).agg(F.sum("__e").alias("__total"))
    rows = rows.join(total, F.col("__by").eqNullSafe(F.col("__g")))
    return rows.select(*df.columns, "logit", (F.col("__e") / F.col("__total")).alias("probability"))


def gumbel_sets(df: DataFrame, by: str, item: str, logit: str, k: int, draws: int, seed: int) -> DataFrame:
    """(by, draw, items): sets of k items without replacement, by the largest perturbed logits, in item order."""
    own = df.select(by, item, logit, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    key = F.concat_ws(":", F.col(by), F.col("draw"), F.col(item))
    own = own.withColumn("__g", F.round(F.col(logit) - F.log(-F.log(uniform(seed, key))), 6))
    order = Window.partitionBy(by, "draw").orderBy(F.col("__g").desc(), item)
    top = own.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return top.groupBy(by, "draw").agg(F.array_sort(F.collect_list(item)).alias("items"))
