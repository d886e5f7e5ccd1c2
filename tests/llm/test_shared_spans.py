import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threshline.llm.alignment import edits
from threshline.llm.shared_spans import blocks_of, chain, members, occurrences, passages, shared_spans

LEAST, SEED = 20, 8


def brute(docs):
    where = {}
    for d, t in docs:
        for p in range(len(t or "") - LEAST + 1):
            where.setdefault(t[p : p + LEAST], set()).add(d)
    out = []
    for d, t in docs:
        marks = [p for p in range(len(t or "") - LEAST + 1) if len(where[t[p : p + LEAST]]) > 1]
        runs = []
        for p in marks:
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + LEAST
            else:
                runs.append([p, p + LEAST])
        out += [(d, s + 1, e - s) for s, e in runs]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, letters="abcdefgh \n日𝔘": "".join(rnd.choices(letters, k=n))
    shared = [text(n) for n in (19, 20, 21, 45, 200)]
    hot = text(33)
    docs = []
    for k in range(70):
        parts = [text(rnd.randint(0, 60))]
        if k % 3 == 0:
            parts += [hot, text(rnd.randint(0, 5))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            s = rnd.choice(shared)
            a = rnd.randint(0, 4)
            parts += [s[a : len(s) - rnd.randint(0, 4)], text(rnd.randint(0, 30))]
        docs.append((k, "".join(parts)))
    return docs + [(100, "z" * 70), (101, "y" + "z" * 30), (102, text(30) * 3), (103, None), (104, ""), (105, "short"), (106, docs[5][1]), (107, docs[5][1])]


@pytest.mark.parametrize("seed,group_rows,keys", [(1, 20_000, 10**6), (2, 4, 10**6), (3, 12, -1)])
def test_against_brute_force(spark, monkeypatch, seed, group_rows, keys):
    monkeypatch.setattr("threshline.llm.shared_spans.MOST_KEYS", keys)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id LONG, text STRING, seed STRING, n INT").repartition(3)
    assert sorted(tuple(r) for r in shared_spans(df, least=LEAST, k=SEED, group_rows=group_rows).collect()) == brute(docs)


def test_nothing_shared_and_empty(spark):
    schema = "doc_id LONG, text STRING"
    assert shared_spans(spark.createDataFrame([], schema)).collect() == []
    assert shared_spans(spark.createDataFrame([(1, "ab" * 400), (None, "ab" * 400)], schema)).collect() == []


def test_fuzzy_passages(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choices("abcdefghijkl ", k=2000))
    changed = base[:900] + "#" + base[901:1500] + "inserted" + base[1500:]
    got = passages(spark.createDataFrame([(1, "x" * 50 + base), (2, changed)], "doc_id LONG, text STRING")).collect()
    best = max((r for r in got if r.doc_id == 1), key=lambda r: r.n_chars)
    assert best.other == 2 and best.n_chars > 1900 and best.n_seeds > 10


def pairs_of(docs, least):
    """Every two documents that share a stretch, by brute force."""
    where = {}
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            where.setdefault(t[p : p + least], set()).add(d)
    return {(a, b) for ds in where.values() for a in ds for b in ds if a < b}


@pytest.mark.parametrize("pair_rows", [4_000, 2])
def test_passage_of_middle_documents(spark, pair_rows):
    """B and C share a passage whose halves others hold first, A the one and D the other; E and F share it last."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    one, two = text(900), text(900)
    docs = [(1, one + text(300)), (2, text(300) + two), (3, text(100) + one + two), (4, one + two + text(50)), (5, text(70) + one), (6, two + text(30)), (7, text(400))]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    got = passages(df, pair_rows=pair_rows).collect()
    # Each holder of a half has it with the half's representative, whole; the representatives lead to all holders.
    assert {(a, b) for a, b in ((r.doc_id, r.other) for r in got) if a < b} >= {(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 6)}
    assert all(r.n_chars >= 880 for r in got)
    groups = {}
    for r in members(df).collect():
        groups.setdefault(r.seed, set()).add(r.doc_id)
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == pairs_of(docs, 200)


@pytest.mark.parametrize("seed", [4, 5])
def test_members_hold_every_link(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    groups = {}
    for r in members(df, least=LEAST, k=SEED).collect():
        groups.setdefault(r.seed, set()).add(r.doc_id)
        assert docs[[d for d, _ in docs].index(r.doc_id)][1][r.start_pos - 1 : r.start_pos - 1 + SEED]
    assert pairs_of(docs, LEAST) <= {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_passages_are_aligned(spark):
    """A common seed alone is no passage; bounds hold on both sides; a long unlike stretch parts two passages."""
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    lone, one, two = text(80), text(500), text(270)
    changed = one[:210] + "#" + one[211:270] + "+++" + one[270:]
    docs = [(1, text(300) + lone + text(300)), (2, text(250) + lone + text(250)), (3, "<" + one + text(300) + two + "<"), (4, ">>" + changed + text(310) + two + ">>")]
    got = passages(spark.createDataFrame(docs, "doc_id LONG, text STRING")).collect()
    assert {(r.doc_id, r.other) for r in got} == {(3, 4), (4, 3)}
    for r in got:
        assert r.identity >= 0.8 and min(r.n_chars, r.other_n_chars) >= 200
    first, second = sorted((r for r in got if r.doc_id == 3), key=lambda r: r.start_pos)
    assert (first.start_pos, first.other_start_pos) == (2, 3) and abs(first.n_chars - 500) < 10 and abs(first.other_n_chars - 503) < 10 and first.identity > 0.97
    assert abs(second.n_chars - 270) < 10 and second.start_pos + second.n_chars == len(docs[2][1]) and second.identity > 0.97


@settings(max_examples=100, deadline=None)
@given(st.text("ab日", max_size=30), st.text("ab日", max_size=30))
def test_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    assert edits(a, b) == row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=14, unique=True))
def test_chain_scores(matches):
    """The strongest chain scores as the best by trying all predecessors."""
    cost, brings = 0.25, 8
    order = sorted(matches)
    best = {}
    for x, y in order:
        best[x, y] = brings + max([0.0, *(best[a, b] - cost * (x - a + y - b) for a, b in best if a < x and b < y)])
    chains = chain([x for x, _ in matches], [y for _, y in matches], brings, cost)
    assert sorted(i for c in chains for i in c) == list(range(len(matches)))
    path = [matches[i] for i in chains[0]]
    assert all(a < x and b < y for (a, b), (x, y) in zip(path, path[1:]))
    score = brings * len(path) - sum(cost * (x - a + y - b) for (a, b), (x, y) in zip(path, path[1:]))
    assert abs(score - max(best.values())) < 1e-9


def test_repeated_seeds_are_matched_in_linear_number(spark):
    assert occurrences([1, 5], [7]) == [(1, 7), (5, 7)] and occurrences([1, 5, 9], [2, 4]) == [(1, 2), (5, 2), (5, 4), (9, 4)]
    docs = [(1, "z" * 6000), (2, "y" + "z" * 5000), (3, "line of a log that comes again\n" * 300), (4, "line of a log that comes again\n" * 200)]
    got = passages(spark.createDataFrame(docs, "doc_id LONG, text STRING")).collect()
    assert {(r.doc_id, r.other): r.n_chars for r in got if r.identity == 1} == {(1, 2): 5000, (2, 1): 5000, (3, 4): 6200, (4, 3): 6200}


def test_chains_are_aligned_to_blocks():
    """Equal runs join along one diagonal; what no block holds stays open for the exact check."""
    match = lambda at, other, before, more, same: {"at": at << 32 | before << 16 | more, "other_at": other << 32, "same": same}
    path = [match(100, 300, 50, 60, True), match(180, 380, 60, 70, True), match(500, 705, 40, 30, True), match(600, 805, 10, 5, False)]
    held, rest = blocks_of(path, 200)
    assert held == [(50, 390), (460, 690)]  # the third match lies on another diagonal
    assert rest == [path[3]]
    assert blocks_of([match(0, 0, 0, 0, True)], 200) == ([(0, 200)], [])
