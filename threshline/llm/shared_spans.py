"""Passages that stand verbatim in more than one document, and how much of each document they make up.

Seeds.  Of the k-mers of every stretch of ``least`` characters the one of lowest mixed hash is a seed, so two equal
stretches always have the same seed at the same place.  A seed stands for the run of stretches it was chosen for.

Links.  Seeds meet by hash, with aggregates only.  The occurrences of one hash form a group, those whose runs are equal a
class within it.  For exact spans each occurrence is linked to one other document: of its class where that has two or more,
else of its group (the first holder, or the last for the first); no pairs within a group are formed, and a hash that a third
of all documents has is split over tasks.  Fuzzy passages need every pair of a group: its documents meet in buckets.
``members`` gives the groups themselves.

Chains.  The common seeds of two documents are chained: ordered matches, scored through a Fenwick tree with a cost for gaps
on both sides.  Each chain is aligned.  For exact spans (``shared_spans``) run by run: equal runs on one diagonal join to
blocks that both texts hold.  For fuzzy passages (``passages``) on both texts: edit distance between seeds, ends extended
while that pays.

Exact check.  What the blocks of the chains leave open are runs that no other document has as a whole (at the ends of
passages).  Only the characters around those go to the group of their hash, where every stretch is compared by hash with
those of other documents, again without pairs.  Groups above GROUP_ROWS take a distributed aggregate over the same
stretches instead of one task.

Defined results: null, empty and short texts share nothing; rows with a null key take no part; stretches repeated only
within one document are not shared; a document id is expected once, rows that repeat an id never share with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.alignment import IDENTITY, aligned, common, equal_before
from threshline.llm.batches import slices
from threshline.llm.document_pairs import Bucket
from threshline.operators.skew import join_by_frequency
from threshline.session import checkpointed, cores

LEAST, SEED = 200, 64
#: Rows of one hash that one task may hold.
GROUP_ROWS = 20_000
#: About how many common seeds of document pairs, and how many characters, one bucket holds at most.
PAIR_ROWS, BUCKET_CHARS = 4_000_000, 32_000_000
#: Tasks that buckets are put to at most.
MOST_TASKS = 20_000
#: Places of one seed in two texts that are all matched with each other.
FEW_PLACES = 64
#: Keys of documents with open seeds that may be broadcast, 8 bytes each.
MOST_KEYS = 2_000_000
#: A chain pays so much a character of gap, on either side, of what a seed brings.
GAP_COST = 0.05
#: Texts longer than this are read in pieces that overlap by one stretch less a character.
PIECE = 4_000_000
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Prefix sums over code points; the hash of any stretch in constant time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power, self.inverse = powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:n])])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + np.uint64(1) * np.asarray(size, np.uint64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def seed_runs(texts: list[str], least: int = LEAST, k: int = SEED) -> tuple[np.ndarray, ...]:
    """(text number, seed hash, run hash, seed position, stretches before it, stretches after it) of every run.

    A run is the stretches, by consecutive starts, that have one seed; positions are 0-based within the text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    empty = tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    n = len(codes)
    if n < least:
        return empty
    hashes = Hashes(codes)
    grams = np.arange(n - k + 1)
    seeds = hashes.of(grams, k)
    # Rank of a k-mer: 40 bits of its hash, then its place, so that the leftmost of equal ones is taken.
    low = sliding_minimum(mix(seeds) & ~np.uint64(0xFFFFFF) | grams.astype(np.uint64), least - k + 1)
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = np.arange(n - least + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(starts)]
    inside = starts + least <= ends[owner]
    starts, place, owner = starts[inside], place[inside], owner[inside]
    if not len(starts):
        return empty
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(owner) != 0)]))
    last = np.append(new[1:], len(starts)) - 1
    first, final, at, who = starts[new], starts[last], place[new], owner[new]
    whole = hashes.of(first, final - first + least)
    return who, seeds[at].view(np.int64), whole.view(np.int64), at - (ends - sizes)[who], at - first, final - first


def seeds_of(docs: DataFrame, key: str, text: str, least: int, k: int) -> DataFrame:
    """(key, seed, run, at): ``at`` packs position << 32 | stretches before the seed << 16 | stretches in all but one."""
    if not 0 < k < least < 1 << 15:
        raise ValueError("a seed must be shorter than a stretch, and a stretch below 32768 characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, texts in ((b, *s) for b in batches for s in slices(b.column(1), 1_000_000)):
            parts, origin, owner = [], [], []
            for n, t in enumerate(texts):
                for o in range(0, max(1, len(t) - least + 1), PIECE):
                    parts.append(t[o : o + PIECE + least - 1] if len(t) > PIECE else t)
                    origin.append(o)
                    owner.append(n)
            origin, owner = np.array(origin, np.int64), np.array(owner, np.int64)
            for lo in range(0, len(parts), max(1, len(parts) if sum(map(len, parts)) < 3 * PIECE else 1)):
                group = parts[lo:] if sum(map(len, parts)) < 3 * PIECE else parts[lo : lo + 1]
                who, seed, whole, place, before, more = seed_runs(group, least, k)
                who = who + lo
                at = (place + origin[who]) << 32 | before << 16 | more
                keys = batch.column(0).slice(start, len(texts)).take(pa.array(owner[who]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(seed), pa.array(whole), pa.array(at)], [key, "seed", "run", "at"])

    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("seed", "run", "at"))])
    return docs.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(key, text).mapInArrow(run, schema)


def shared_seeds(docs: DataFrame, key: str, text: str, least: int, k: int) -> DataFrame:
    """(key, seed, run, at, n, mixed, low, low_at, high, high_at): every occurrence of the seeds that several documents have.

    ``n`` counts the occurrences, ``mixed`` says whether their runs differ, low and high are its first and last holders.
    """
    # Written once: the texts are read for seeds a single time, by the counts and by the join.
    seeds = checkpointed(seeds_of(docs, key, text, least, k))
    by_seed = seeds.groupBy("seed").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("mixed"), *_holders(key, ""))
    shared = checkpointed(by_seed.where("low <> high"))  # read by the search for heavy seeds and by the join
    return join_by_frequency(seeds, shared, "seed", "n", F.col(key)).select(key, "seed", "run", "at", "n", "mixed", "low", "low_at", "high", "high_at")


def _holders(key: str, name: str) -> list[Column]:
    return [f.alias(name + n) for n, f in (("low", F.min(key)), ("low_at", F.min_by("at", key)), ("high", F.max(key)), ("high_at", F.max_by("at", key)))]


def linked_seeds(docs: DataFrame, key: str, text: str, least: int, k: int) -> DataFrame:
    """(key, seed, run, at, n, other, other_at, same): each shared seed with the occurrence it is linked to, written once.

    ``same``: the other one has the same run, so all stretches of the run are shared as they are.
    """
    held = checkpointed(shared_seeds(docs, key, text, least, k))
    pick = lambda which, c: F.when(F.col(key) == F.col(f"{which}low"), F.col(f"{which}high{c}")).otherwise(F.col(f"{which}low{c}"))
    plain = held.where("NOT mixed").select(key, "seed", "run", "at", "n", pick("", "").alias("other"), pick("", "_at").alias("other_at"), F.lit(True).alias("same"))
    mixed = held.where("mixed").withColumn("_class", F.xxhash64("seed", "run"))
    # A class is looked up by seed and run; large ones are split, so a frequent seed does not meet in one task.
    classes = checkpointed(mixed.groupBy("_class", F.col("seed").alias("_seed"), F.col("run").alias("_run")).agg(F.count("*").alias("_n"), *_holders(key, "c_")))
    classed = join_by_frequency(mixed, classes.where("c_low <> c_high"), "_class", "_n", F.col(key), "left")
    same = F.coalesce((F.col("seed") == F.col("_seed")) & (F.col("run") == F.col("_run")), F.lit(False))
    choice = lambda c: F.when(same, pick("c_", c)).otherwise(pick("", c))
    return checkpointed(plain.unionByName(classed.select(key, "seed", "run", "at", "n", choice("").alias("other"), choice("_at").alias("other_at"), same.alias("same"))))


def chain(places: list[int], others: list[int], brings: int, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of matches (place here, place there), each match in one chain.

    The best chain that ends in a match follows from a Fenwick tree of prefix maxima over the places there: with a cost
    linear in both gaps, the score to extend is known up to terms of the new match alone.
    """
    order = sorted(range(len(places)), key=lambda i: (places[i], others[i]))
    rank = {v: r for r, v in enumerate(sorted(set(others)), 1)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(rank) + 1)
    before: dict[int, int] = {}
    score: dict[int, float] = {}
    k = 0
    while k < len(order):
        group = [order[k]]  # matches at one place here never follow each other
        while k + len(group) < len(order) and places[order[k + len(group)]] == places[order[k]]:
            group.append(order[k + len(group)])
        for i in group:
            best, r = (float("-inf"), -1), rank[others[i]] - 1
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - gap_cost * (places[i] + others[i])
            score[i] = brings + max(0.0, gain)
            if gain > 0:
                before[i] = best[1]
        for i in group:
            entry, r = (score[i] + gap_cost * (places[i] + others[i]), i), rank[others[i]]
            while r < len(tree):
                tree[r] = max(tree[r], entry)
                r += r & -r
        k += len(group)
    chains, used = [], set()
    for i in sorted(order, key=lambda i: (-score[i], places[i], others[i])):
        path, j = [], i
        while j is not None and j not in used:
            path.append(j)
            used.add(j)
            j = before.get(j)
        if path:
            chains.append(path[::-1])
    return chains


def passages_of(matches: list[dict], least: int, k: int) -> list[tuple[object, list[dict]]]:
    """(other document, its chained matches in order), strongest first within a document pair."""
    by_other: dict[object, list[dict]] = {}
    for m in matches:
        by_other.setdefault(m["other"], []).append(m)
    out = []
    for other in sorted(by_other):
        ms = by_other[other]
        for path in chain([m["at"] >> 32 for m in ms], [m["other_at"] >> 32 for m in ms], k):
            out.append((other, [ms[i] for i in path]))
    return out


def extent(at: int) -> tuple[int, int]:
    """(first start, last start) of the stretches of a packed run."""
    first = (at >> 32) - (at >> 16 & 0xFFFF)
    return first, first + (at & 0xFFFF)


def blocks_of(path: list[dict], least: int) -> tuple[list[tuple[int, int]], list[dict]]:
    """A chain aligned run by run: (bounds of what both documents hold, matches that the alignment leaves open).

    Equal runs that overlap or touch on one diagonal join to one block; a match inside a block of its own diagonal is settled.
    """
    blocks: list[list[int]] = []  # [start, end, diagonal]
    for m in path:
        first, final = extent(m["at"])
        diagonal = (m["at"] >> 32) - (m["other_at"] >> 32)
        if m["same"]:
            if blocks and blocks[-1][2] == diagonal and first <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], final + least)
            else:
                blocks.append([first, final + least, diagonal])
    held = [(s, e) for s, e, _ in blocks]
    rest = [m for m in path if not m["same"] and not any(s <= extent(m["at"])[0] and extent(m["at"])[1] + least <= e for s, e in held)]
    return held, rest


def members(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, k: int = SEED) -> DataFrame:
    """(seed, key, start_pos): who belongs to which group, that is, which documents hold the same seed, and where.

    Two documents that share a stretch of ``least`` characters are members of a common group, so this holds every link.
    """
    return shared_seeds(docs, key, text, least, k).select("seed", key, (F.shiftright("at", 32) + 1).cast("int").alias("start_pos"))


def occurrences(mine: list[int], theirs: list[int]) -> list[tuple[int, int]]:
    """Places of one seed in two texts that are matched: all with the only one, else those of one rank from either end.

    So a line that both texts repeat a thousand times gives some thousand matches, not a million; every place of either text
    is matched.
    """
    if len(mine) == 1 or len(theirs) == 1:
        return [(x, y) for x in mine for y in theirs]
    mine, theirs = sorted(mine), sorted(theirs)
    found = {*zip(mine, theirs), *zip(mine[::-1], theirs[::-1])}
    for known, side, long, short in ((0, lambda x, y: (x, y), mine, theirs), (1, lambda x, y: (y, x), theirs, mine)):
        matched = {m[known] for m in found}
        found |= {side(x, short[n % len(short)]) for n, x in enumerate(long) if x not in matched}
    return sorted(found)


def equal_windows(mine: tuple[str, dict[int, list[int]]], theirs: tuple[str, dict[int, list[int]]], seeds: list[int], least: int) -> set[tuple[int, int]]:
    """Matches of repeated seeds: every place whose stretch of ``least`` characters both texts hold has one in the other."""
    sides: list[dict[int, list[int]]] = []
    for text, places in (mine, theirs):
        runs = np.array([(*extent(at), at >> 32) for seed in seeds for at in places[seed]], np.int64)
        runs = runs[runs[:, 1] + least <= len(text)]
        n = runs[:, 1] - runs[:, 0] + 1
        start = np.repeat(runs[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes = Hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).of(start, least)
        found: dict[int, list[int]] = {}
        for code, place in zip(codes.tolist(), np.repeat(runs[:, 2], n).tolist()):
            found.setdefault(code, []).append(place)
        sides.append(found)
    alike = {(tuple(sides[0][code]), tuple(sides[1][code])) for code in sides[0].keys() & sides[1].keys()}
    return {match for xs, ys in alike for match in occurrences(sorted({*xs}), sorted({*ys}))}


def pair_matches(mine: tuple[str, dict[int, list[int]]], theirs: tuple[str, dict[int, list[int]]], least: int, k: int) -> list[tuple[int, int]]:
    """(place here, place there) of the common seeds of two texts: all places of a seed where they are few."""
    (a, mine_at), (b, theirs_at) = mine, theirs
    found: set[tuple[int, int]] = set()
    many = []
    for seed in mine_at.keys() & theirs_at.keys():
        xs, ys = (sorted({at >> 32 for at in side[seed]}) for side in (mine_at, theirs_at))
        if len(xs) * len(ys) <= FEW_PLACES:
            found.update((x, y) for x in xs for y in ys)
        else:
            found.update(occurrences(xs, ys))
            many.append(seed)
    if many:
        found |= equal_windows(mine, theirs, many, least)
    return sorted((x, y) for x, y in found if len(a) >= x + k and a[x : x + k] == b[y : y + k])


def pair_passages(mine: tuple[str, dict[int, list[int]]], theirs: tuple[str, dict[int, list[int]]], least: int, k: int) -> list[tuple[int, int, int, int, int, int]]:
    """Aligned passages of two documents, given as text and packed places of each seed; one within another on both sides is left out.

    What the alignment of the chains leaves out is aligned once more alone: a match that lies in no passage, and a match
    whose equal stretch of ``least`` characters or more does not lie in one as a whole.
    """
    a, b = mine[0], theirs[0]
    places = pair_matches(mine, theirs, least, k)
    out: list[tuple[int, int, int, int, int, int]] = []
    tried: set[tuple[int, int]] = set()

    def held(s: int, e: int, t: int, f: int) -> bool:
        return any(o[0] <= s and e <= o[1] and o[2] <= t and f <= o[3] for o in out)

    def align(path: list[tuple[int, int]]) -> None:
        if len(path) == 1:
            tried.add(path[0])
        for s, e, t, f, changed, n in aligned(a, b, path, k, least):
            if min(e - s, f - t) >= least and changed <= (1 - IDENTITY) * max(e - s, f - t) and not held(s, e, t, f):
                out[:] = [o for o in out if not (s <= o[0] and o[1] <= e and t <= o[2] and o[3] <= f)]
                out.append((s, e, t, f, changed, n))

    for path in chain([x for x, _ in places], [y for _, y in places], k) if len(places) > 1 else [[0]] * len(places):
        (x, y), (u, v) = places[path[0]], places[path[-1]]
        if not held(x, u + k, y, v + k):
            align([places[i] for i in path])
    ends: dict[int, int] = {}  # by diagonal, how far its last equal stretch reaches
    for x, y in places:
        if x + k <= ends.get(x - y, 0):
            continue  # the same stretch again
        before = equal_before(a, x, b, y)
        ahead = x + k + common(a, x + k, b, y + k, min(len(a) - x, len(b) - y) - k)
        ends[x - y] = ahead
        s, e = (x - before, ahead) if ahead - x + before >= least else (x, x + k)
        if (x, y) not in tried and not held(s, e, s - x + y, e - x + y):
            align([(x, y)])
    return out


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, k: int = SEED, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Fuzzy passages: (key, start_pos, n_chars, other, other_start_pos, other_n_chars, n_seeds, identity), a row per passage and side.

    Every two documents that have a common seed are chained over all their common seeds, and each chain is aligned on both
    texts; two documents that share ``least`` equal characters always have one.  So rows grow with the pairs, not with the
    documents.  A passage has ``least`` characters or more on both sides, of which IDENTITY or more is equal: one less its
    edits a character of the longer side.  Documents go to sides by the hash of their key and a bucket holds two sides:
    a document is sent once to each bucket where it has a pair, and pairs are formed within the task alone.
    """
    spark = docs.sparkSession
    held = checkpointed(shared_seeds(docs, key, text, least, k).select(key, "seed", "at"))
    holders = checkpointed(held.select("seed", key).distinct())
    texts = docs.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(key, F.col(text).alias("_text"))
    keys = held.select(key).distinct()
    if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        texts = texts.join(F.broadcast(keys), key, "left_semi")
    per_doc = checkpointed(texts.join(held.groupBy(key).agg(F.collect_list(F.struct("seed", "at")).alias("seeds")), key))
    pairs = holders.groupBy("seed").count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0
    chars = per_doc.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = max(1, math.ceil(math.sqrt(2 * pairs / pair_rows)), math.ceil(2 * chars / BUCKET_CHARS), math.ceil(math.sqrt(4 * cores(spark))) if pairs > pair_rows // 100 else 1)
    placed = holders.withColumn("_side", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)).cast("int"))
    # A seed has at most n sides, so that a frequent one needs no pairs to tell its buckets.
    met = placed.groupBy("seed").agg(F.count("*").alias("_n"), F.collect_set("_side").alias("_sides"))
    joined = join_by_frequency(placed, met, "seed", "_n", F.col(key)).select(key, "_side", F.explode("_sides").alias("_other"))
    # The number of a bucket counts the pairs of sides, so that each is a task of its own.
    high = F.greatest("_side", "_other").cast("bigint")
    bucket_ = F.shiftright(high * (high + 1), 1) + F.least("_side", "_other")
    wanted = joined.select(key, bucket_.alias("bucket"), (F.col("_side") <= F.col("_other")).alias("left"), (F.col("_side") >= F.col("_other")).alias("right"))
    needs = wanted.distinct().join(per_doc, key).select("bucket", "left", "right", key, "seeds", "_text")
    names = [key, "start_pos", "n_chars", "other", "other_start_pos", "other_n_chars", "n_seeds", "identity"]

    def settle(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_ = pa.chunked_array([b.column(3) for b in batches]).combine_chunks()
        lists = pa.chunked_array([b.column(4) for b in batches]).combine_chunks()
        left, right = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]).astype(bool) for c in (1, 2))
        each = lists.flatten()
        codes = docs_.dictionary_encode().indices.to_numpy()
        owner = np.repeat(np.arange(len(docs_)), pa.compute.list_value_length(lists).to_numpy())
        bucket = Bucket(codes, [t for b in batches for t in b.column(5).to_pylist()], left, right, owner, each.field(0).to_numpy(), each.field(1).to_numpy())
        for found in bucket.passages(least, k, pair_passages):
            for a, b, which in bucket.rows(found):
                _, _, s, e, t, f, changed, n_seeds = found[:, which]
                alike = 1 - changed / np.maximum(e - s, f - t)
                both = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int32))
                columns = [docs_.take(pa.array(np.concatenate([a, b]))), both(s + 1, t + 1), both(e - s, f - t), docs_.take(pa.array(np.concatenate([b, a]))), both(t + 1, s + 1), both(f - t, e - s)]
                yield pa.RecordBatch.from_arrays([*columns, both(n_seeds, n_seeds), pa.array(np.concatenate([alike, alike]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: each is settled when the next one begins."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if waiting and waiting[-1].column(0)[0].as_py() != numbers[lo]:
                    yield from settle(waiting)
                    waiting = []
                waiting.append(batch.slice(lo, hi - lo))
        if waiting:
            yield from settle(waiting)

    kinds = {key: docs.schema[key].dataType, "other": docs.schema[key].dataType, "identity": T.DoubleType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.IntegerType())) for c in names])
    return needs.repartitionById(min(n * (n + 1) // 2, MOST_TASKS), F.pmod("bucket", F.lit(MOST_TASKS)).cast("int")).sortWithinPartitions("bucket").mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, k: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, start_pos, n_chars): the maximal runs of characters that lie in stretches other documents have too."""
    kind = docs.schema[key].dataType
    linked = linked_seeds(docs, key, text, least, k)
    # The list of a document is bounded by its length.
    listed = linked.groupBy(key).agg(F.collect_list(F.struct("seed", "at", "n", "other", "other_at", "same")).alias("matches"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of aligned chains, merged (seed null), and the seeds that they leave open."""
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sure: list[tuple[int, int]] = []
                rest: list[dict] = []
                for _, path in passages_of(ms, least, k):
                    held, left = blocks_of(path, least)
                    sure += held
                    rest += left
                for m in rest:
                    first, final = extent(m["at"])
                    for column, x in zip(rows, (doc, first, final + least, m["seed"], m["n"])):
                        column.append(x)
                for s, e in _merged(sure):
                    for column, x in zip(rows, (doc, s, e, None, None)):
                        column.append(x)
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], [key, "s", "e", "seed", "n"])

    span = [T.StructField(key, kind), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]
    candidates = checkpointed(listed.mapInArrow(align, T.StructType([*span, T.StructField("seed", T.LongType()), T.StructField("n", T.LongType())])))
    sure = candidates.where("seed IS NULL").select(key, "s", "e")
    open_ones = _surroundings(docs, key, text, least, candidates.where("seed IS NOT NULL"), linked)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by seed: each group, at most group_rows, is settled when the next one begins."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            seeds = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(seeds)) + 1).tolist(), len(seeds)] if len(seeds) else []
            if held and cuts and held[-1].column(3)[0].as_py() != seeds[0]:
                yield settle(held)
                held = []
            if len(cuts) > 2:  # all but the last group end in this batch
                yield settle([*held, batch.slice(0, cuts[-2])])
                held = [batch.slice(cuts[-2])]
            elif cuts:
                held.append(batch)
        if held:
            yield settle(held)

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        docs_, seeds, first = whole.column(0).combine_chunks(), whole.column(3).to_numpy(), whole.column(1).to_numpy()
        row, start, shared_hash = stretches(whole.column(5).to_pylist(), least)
        code = pa.compute.dictionary_encode(docs_)
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        shared = in_several(mix(shared_hash ^ mix(seeds.view(np.uint64))[row]), code[row])
        row, start = row[shared], start[shared] + first[row[shared]]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)])) if len(row) else np.empty(0, np.int64)
        last = np.append(new[1:], len(row)) - 1 if len(new) else new
        return pa.RecordBatch.from_arrays([docs_.take(pa.array(row[new])), pa.array(start[new].astype(np.int32)), pa.array((start[last] + least).astype(np.int32))], [key, "s", "e"])

    small = open_ones.where(F.col("n") <= group_rows).select(key, "s", "e", "seed", "n", "around")
    settled = small.repartition("seed").sortWithinPartitions("seed").mapInArrow(within, T.StructType(span))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, code = stretches(batch.column(5).to_pylist(), least)
            first = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((start + first[row]).astype(np.int32)), pa.array(code.view(np.int64))], [key, "s", "stretch"])

    large = open_ones.where(F.col("n") > group_rows).select(key, "s", "e", "seed", "n", "around").mapInArrow(explode, T.StructType([*span[:2], T.StructField("stretch", T.LongType())]))
    large = checkpointed(large)  # read by the counts and by the join
    counted = large.groupBy("stretch").agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.count("*").alias("n")).where("_low <> _high").select("stretch", "n")
    spread = join_by_frequency(large, counted, "stretch", "n", F.col(key)).select(key, "s", (F.col("s") + least).alias("e"))
    return merge_spans(sure.unionByName(settled).unionByName(spread), key)


def _surroundings(docs: DataFrame, key: str, text: str, least: int, rest: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, s, e, seed, n, around): the characters of the open runs, and of two holders of every class of the same seeds.

    Only texts of these documents are read by key: the keys are broadcast when a count shows that they are few.
    """
    seeds = rest.groupBy("seed").agg(F.count("*").alias("_open"))
    of_class = linked.where("same").select("seed", "run", key, "at", "n").join(seeds.select("seed"), "seed", "left_semi")
    first = F.shiftright("at", 32) - F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF))
    two = of_class.groupBy("seed", "run").agg(F.max("n").alias("n"), *_holders(key, ""))
    both = two.select("seed", "n", F.explode(F.array(F.struct(F.col("low").alias(key), F.col("low_at").alias("at")), F.struct(F.col("high").alias(key), F.col("high_at").alias("at")))).alias("_x")).select("seed", "n", "_x.*")
    others = both.select(key, first.cast("int").alias("s"), (first + F.col("at").bitwiseAND(F.lit(0xFFFF)) + least).cast("int").alias("e"), "seed", "n")
    wanted = checkpointed(rest.unionByName(others))
    texts = docs.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(key, F.col(text).alias("_text"))
    keys = wanted.select(key).distinct()
    if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        texts = texts.join(F.broadcast(keys), key, "left_semi")
    places = wanted.groupBy(key).agg(F.collect_list(F.struct("s", "e", "seed", "n")).alias("_places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, group in ((b, *s) for b in batches for s in slices(b.column(0), 1_000_000)):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, t, at in zip(batch.column(1).slice(start, len(group)).to_pylist(), group, batch.column(2).slice(start, len(group)).to_pylist()):
                for p in at:
                    for column, x in zip(rows, (doc, p["s"], p["e"], p["seed"], p["n"], t[p["s"] : p["e"]])):
                        column.append(x)
            types = (batch.schema.field(1).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], [key, "s", "e", "seed", "n", "around"])

    kinds = (docs.schema[key].dataType, T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([T.StructField(c, t) for c, t in zip((key, "s", "e", "seed", "n", "around"), kinds)])
    return checkpointed(texts.join(places, key).select("_text", key, "_places").mapInArrow(cut, schema))


def stretches(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of every stretch of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = Hashes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    counts = np.maximum(sizes - least + 1, 0)
    row = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, start, hashes.of(start + (np.cumsum(sizes) - sizes)[row], least)


def in_several(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which codes occur with two or more documents: one sort, no pairs."""
    if not len(codes):
        return np.zeros(0, bool)
    order = np.argsort(codes, kind="stable")
    code, doc = codes[order], docs[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    out = np.zeros(len(codes), bool)
    out[order] = np.repeat(several, np.diff(np.append(new, len(code))))
    return out


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping and touching spans of a document as one: (key, start_pos, n_chars).  A group is one document's spans."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", (reach.isNull() | (F.col("s") > reach)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(key, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select(key, (F.col("s") + 1).cast("int").alias("start_pos"), (F.col("e") - F.col("s")).cast("int").alias("n_chars"))
