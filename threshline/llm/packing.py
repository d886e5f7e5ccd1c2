"""Fixed-capacity containers filled with texts that fit together, by lexical retrieval.

Texts go to tasks by the hash of a lexical route (how dense signs, blanks and line ends are, and the first long word), so
that related texts meet; a route that has more texts than half a task, as counted over all texts, is split.  Within a task
texts are ordered by route and cut into shards.
A shard holds an inverted index of BM25 weights over the tokens of its unused texts.  The
largest unused text opens a container and queries the index with all its terms; unused neighbours fill the container in
order of their score, and what room is left takes the largest texts that still fit.  Containers that stay below
FULL_SHARE give their texts back to the next shard of the task; only a task's last shard keeps them.

Only a text larger than the capacity is split: into full containers and a rest that is packed like any other text.

Defined results: null and empty texts are in no container; null keys are packed like others; a repeated row is packed
again; each token of each text is in exactly one container.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.batches import slices
from threshline.llm.tokenizer import DEFAULT_VOCABULARY, encoder
from threshline.session import checkpointed, cores, input_bytes

CAPACITY = 2048
#: Texts in the index of one shard; bounds memory and time.
SHARD_TEXTS = 2048
#: A container this full is kept before its task ends.
FULL_SHARE = 0.995
#: Bytes of stored text a task packs, at least and at most: few large tasks leave few last containers, and the number of
#: tasks follows the cores in between, so that it stays far below what one shuffle can serve.
TASK_BYTES, TASK_MOST = 8 << 20, 512 << 20
TASKS_A_CORE = 4
K1, B = 1.2, 0.75


class Index:
    """BM25 weights of the texts of a shard by term."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = len(terms)
        lengths = np.array([c.sum() for c in counts], np.float64)
        flat, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        owner = np.repeat(np.arange(n), [len(t) for t in terms])
        vocabulary, code = np.unique(flat, return_inverse=True)
        order = np.argsort(code, kind="stable")
        frequency = np.bincount(code, minlength=len(vocabulary))
        # A term that most texts have says nothing; its weight is nought, so it has no postings.
        idf = np.maximum(np.log((n - frequency + 0.5) / (frequency + 0.5)), 0.0)
        weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / max(lengths.mean(), 1.0))[owner]))
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        self.ends = np.cumsum(frequency)
        self.starts = self.ends - frequency
        useful = idf > 0
        cuts = np.cumsum([0, *(len(t) for t in terms)])
        self.queries = [code[a:b][useful[code[a:b]]] for a, b in zip(cuts, cuts[1:])]
        self.n = n

    def scores(self, k: int) -> np.ndarray:
        """Score of every text for the terms of text k."""
        terms = self.queries[k]
        sizes = self.ends[terms] - self.starts[terms]
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(self.starts[terms] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.owner[at], self.weight[at], self.n)


def fill(sizes: np.ndarray, index: Index | None, capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every item is in one."""
    order = np.argsort(sizes, kind="stable")
    free = [(int(sizes[i]), int(i)) for i in order]  # ascending, so the largest that fits is found by bisection
    unused = np.ones(len(sizes), bool)
    out = []

    def take(i: int) -> None:
        unused[i] = False
        del free[bisect_right(free, (int(sizes[i]), i)) - 1]

    while free:
        seed = free[-1][1]
        take(seed)
        box, room = [seed], capacity - int(sizes[seed])
        if index is not None and free and room >= free[0][0]:
            scores = index.scores(seed)
            near = np.flatnonzero((scores > 0) & unused & (sizes <= room))
            for i in near[np.lexsort((near, -scores[near]))].tolist():
                if sizes[i] <= room:
                    take(i)
                    box.append(i)
                    room -= int(sizes[i])
                    if not free or room < free[0][0]:
                        break
        while free and (k := bisect_right(free, (room, len(sizes)))):
            i = free[k - 1][1]
            take(i)
            box.append(i)
            room -= int(sizes[i])
        if room and len(box) > 1:
            room = tighten(box, room, sizes, free, unused)
        out.append(box)
    return out


def tighten(box: list[int], room: int, sizes: np.ndarray, free: list[tuple[int, int]], unused: np.ndarray) -> int:
    """Exchanges one text of a container for an unused one that is larger by at most the room left."""
    best: tuple[int, int, int] | None = None
    for place in range(1, len(box)):
        old = int(sizes[box[place]])
        k = bisect_right(free, (old + room, len(sizes))) - 1
        if k >= 0 and free[k][0] > old and (best is None or free[k][0] - old > best[0]):
            best = (free[k][0] - old, place, k)
    if best is None:
        return room
    gain, place, k = best
    size, new = free.pop(k)
    unused[new] = False
    old = box[place]
    box[place] = new
    unused[old] = True
    insort(free, (int(sizes[old]), old))
    return room - gain


def route_of(text: Column) -> Column:
    """Texts of one kind have one beginning of the route: ten degrees each of signs, blanks and line ends, and the alphabet.  The first long word follows."""
    n = F.length(text)
    degree = lambda count, scale: F.least(F.lit(9), F.floor(scale * count / n)).cast("string")
    of = lambda char: n - F.length(F.replace(text, F.lit(char), F.lit("")))
    word = F.lower(F.left(F.regexp_extract(text, r"\p{L}{5,}", 0), F.lit(64)))
    return F.concat(degree(F.regexp_count(text, F.lit(r'[(){};=<>"]')), 40), degree(of(" "), 30), degree(of("\n"), 60), F.when(F.octet_length(text) == n, "a").otherwise("u"), word)


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(container_id, key, first_token, n_tokens): what part of which text each container holds, first_token from 1.

    One shuffle, of the texts by route; they are encoded behind it, so that tokens are never moved.  When more than half of
    a shard fits nowhere, its containers are closed as they are, so that memory stays bounded; ``fill_report`` counts them.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark, size = docs.sparkSession, input_bytes(docs, text)
    tasks = max(1, math.ceil(size / TASK_MOST), min(math.ceil(size / TASK_BYTES), TASKS_A_CORE * cores(spark)))
    source = docs.where(F.length(text) > 0).select(key, text, route_of(F.col(text)).alias("_route"))
    routed = source.select(key, text, "_route", F.lit(0).alias("_part"))
    if tasks > 1:
        # Written once, so that the route of each text is found once, for the counts and for the shuffle.
        source = checkpointed(source)
        counts = source.groupBy("_route").agg(F.count("*").alias("_n"))
        share = max(1, source.count() // (2 * tasks))
        # At most 2 * tasks routes have more texts than that.
        heavy = counts.where(F.col("_n") > share).select("_route", F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
        part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(key, text), F.col("_parts")).cast("int"))
        routed = source.join(F.broadcast(heavy), "_route", "left").select(key, text, "_route", part.alias("_part"))
        routed = routed.repartition(tasks, "_route", "_part")
    else:
        routed = routed.coalesce(1)
    routed = routed.sortWithinPartitions("_route", "_part", key).select(key, text)
    number = T.StructField(key, docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, made = encoder(vocabulary), TaskContext.get().partitionId(), 0
        items: list[tuple] = []  # (key, first token from 0, size, terms, counts)
        rows: tuple[list, ...] = ([], [], [], [])

        def keep(parts: list[tuple]) -> None:
            nonlocal made
            for part in parts:
                for column, x in zip(rows, (task << 33 | made, part[0], part[1] + 1, part[2])):
                    column.append(x)
            made += 1

        def flush(last: bool) -> list[tuple]:
            if not items:
                return []
            sizes = np.array([x[2] for x in items], np.int64)
            left = []
            for box in fill(sizes, Index([x[3] for x in items], [x[4] for x in items]), capacity):
                if last or sizes[box].sum() >= FULL_SHARE * capacity:
                    keep([items[i] for i in box])
                else:
                    left += [items[i] for i in box]
            return left

        def written(kind: pa.DataType) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), kind, pa.int32(), pa.int32()))], ["container_id", key, "first_token", "n_tokens"])
            for column in rows:
                column.clear()
            return batch

        kind = None
        for batch, start, texts in ((b, *s) for b in batches for s in slices(b.column(1))):
            kind = batch.schema.field(0).type
            ids, offsets = enc.encode_batch(texts)
            for name, a, b in zip(batch.column(0).slice(start, len(texts)).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                first = 0
                while b - a - first > capacity:
                    keep([(name, first, capacity)])
                    first += capacity
                terms, counts = np.unique(ids[a + first : b], return_counts=True)
                items.append((name, first, b - a - first, terms, counts))
                if len(items) >= shard_texts:
                    items = flush(False)
                    if len(items) > shard_texts // 2:  # too many that fit nowhere: close them, memory stays bounded
                        items = flush(True)
            if rows[0]:
                yield written(kind)
        flush(True)
        if rows[0]:
            yield written(kind)

    schema = T.StructType([T.StructField("container_id", T.LongType()), number, T.StructField("first_token", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())])
    return routed.mapInArrow(run, schema)


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, those below FULL_SHARE, tokens, fill share in per cent, and the least containers for as many tokens."""
    per = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.count_if(F.col("n") < FULL_SHARE * capacity).alias("underfilled"), F.sum("n").alias("tokens"), F.round(100 * F.sum("n") / (F.count("*") * capacity), 2).alias("fill_percent"), F.ceil(F.sum("n") / capacity).alias("least_containers"))
