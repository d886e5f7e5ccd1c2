import random

import numpy as np
import pytest

from tests.llm.test_shared_spans import LEAST, SEED, corpus, pairs_of
from threshline.llm.alignment import equal_before, extended
from threshline.llm.document_pairs import WIDTH, Bucket, extended_rows
from threshline.llm.shared_spans import occurrences, pair_passages, passages, seed_runs


def listed(text, least, k):
    """A text with the packed places of its seeds, as pairs of documents are aligned."""
    found = {}
    for _, seed, _, place, before, more in zip(*(c.tolist() for c in seed_runs([text], least, k))):
        found.setdefault(seed, []).append(place << 32 | before << 16 | more)
    return text, found


def uncovered(a, b, spans, least):
    """Places of a whose stretch b holds too and that no passage holds as a whole; spans are (start, end), 0-based."""
    theirs = {b[y : y + least] for y in range(len(b) - least + 1)}
    return [x for x in range(len(a) - least + 1) if a[x : x + least] in theirs and not any(s <= x and x + least <= e for s, e in spans)]


@pytest.mark.parametrize("pair_rows", [10**6, 3])
def test_every_pair_of_a_passage_is_listed(spark, pair_rows):
    """A passage of fifteen documents has 105 pairs, not the fourteen with a representative."""
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    hot, other = text(300), text(260)
    docs = [(d, text(rnd.randint(0, 90)) + hot + text(rnd.randint(0, 90))) for d in range(12)]
    docs += [(20, text(40) + other), (21, other + text(70)), (22, text(30) + hot[:250] + text(20) + other), (23, docs[4][1]), (24, docs[4][1]), (25, text(500)), (26, None), (27, "")]
    got = passages(spark.createDataFrame(docs, "doc_id LONG, text STRING"), pair_rows=pair_rows).collect()
    wanted = pairs_of(docs, 200)
    assert len(wanted) == 108 and {(r.doc_id, r.other) for r in got} == wanted | {(b, a) for a, b in wanted}
    assert len({tuple(r) for r in got}) == len(got)
    by_id = dict(docs)
    for r in got:
        assert r.identity >= 0.8 and min(r.n_chars, r.other_n_chars) >= 200
        if (r.doc_id, r.other) == (23, 24):
            assert (r.start_pos, r.n_chars, r.other_n_chars, r.identity) == (1, len(by_id[23]), len(by_id[24]), 1)


@pytest.mark.parametrize("seed,pair_rows", [(8, 10**6), (9, 40)])
def test_pairs_against_brute_force(spark, seed, pair_rows):
    """Every pair that shares a stretch is listed, and every such stretch lies in a passage of the pair on both sides."""
    docs = corpus(seed)
    spans = {}
    for r in passages(spark.createDataFrame(docs, "doc_id LONG, text STRING"), least=LEAST, k=SEED, pair_rows=pair_rows).collect():
        spans.setdefault((r.doc_id, r.other), []).append((r.start_pos - 1, r.start_pos - 1 + r.n_chars))
    by_id = dict(docs)
    for a, b in pairs_of(docs, LEAST):
        assert not uncovered(by_id[a], by_id[b], spans[a, b], LEAST) and not uncovered(by_id[b], by_id[a], spans[b, a], LEAST)


def test_rows_of_one_id_are_no_pair(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    one, two = text(300), text(310)
    docs = [("p", one + text(50)), ("p", two + text(60) + one), ("q", text(20) + one), ("r", two)]
    got = passages(spark.createDataFrame(docs, "doc_id STRING, text STRING")).collect()
    assert {(r.doc_id, r.other) for r in got} == {("p", "q"), ("q", "p"), ("p", "r"), ("r", "p")}
    assert sorted((r.start_pos, r.n_chars >= 300) for r in got if r.doc_id == "p" and r.other == "q") == [(1, True), (371, True)]


@pytest.mark.parametrize("times", [2, 5, 30])
def test_places_of_repeated_seeds(times):
    """A block too short for a passage stands between changing neighbours, in another order in each text."""
    rnd = random.Random(times)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    block = text(150)
    framed = [text(30) + block + text(30) for _ in range(times)]
    a, b = ((text(60)).join(rnd.sample(framed, times)) for _ in range(2))
    found = pair_passages(listed(a, 200, 64), listed(b, 200, 64), 200, 64)
    assert not uncovered(a, b, [(s, e) for s, e, *_ in found], 200) and not uncovered(b, a, [(t, f) for _, _, t, f, *_ in found], 200)


def test_every_place_is_matched():
    found = occurrences(list(range(0, 100, 10)), [1, 2])
    assert {x for x, _ in found} == set(range(0, 100, 10)) and {y for _, y in found} == {1, 2} and len(found) <= 14


def test_ends_as_rows():
    """Whole arrays of ends give what one end gives, forward and backward."""
    rnd = random.Random(13)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choices("abc日", k=rnd.randint(0, 90)))
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choices("abc", k=rnd.randint(0, 1))
        pairs.append((a, "".join(b) + "".join(rnd.choices("abc", k=rnd.randint(0, 9)))))
    whole = "\0" * WIDTH + "".join(a + b for a, b in pairs) + "\0" * WIDTH
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([[len(a), len(b)] for a, b in pairs])
    starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2) + WIDTH
    for step in (1, -1):
        first = starts if step > 0 else starts + sizes - 1
        i, j, edits, over = extended_rows(codes, first[:, 0], first[:, 1], sizes[:, 0], sizes[:, 1], np.full(len(pairs), step))
        assert over.sum() < 100
        for n, (a, b) in enumerate(pairs):
            if not over[n]:
                assert (i[n], j[n], edits[n]) == extended(a[::step], b[::step])


def test_equal_characters_before():
    assert equal_before("xabc", 4, "yyabc", 5) == 3 and equal_before("abc", 0, "abc", 2) == 0
    assert equal_before("q" + "a" * 3000, 3001, "r" + "a" * 2500, 2501) == 2500 and equal_before("ab" * 700, 1400, "ab" * 900, 1800) == 1400


def test_holders_of_equal_texts_in_parts(monkeypatch):
    """Many holders of one text come in parts: each two of them once, on one side as on two."""
    monkeypatch.setattr("threshline.llm.document_pairs.OUT", 7)
    keys, none = np.arange(9), np.empty(0, np.int64)
    left = keys < 4
    for one, two, wanted in ((left, ~left, 20), (left | True, left | True, 36)):
        bucket = Bucket(keys, ["a" * 200] * 5 + ["b" * 200] * 4, one, two, none, none, none)
        found = np.array([[0, 0, 1], [0, 1, 1], *[[0] * 3] * 6])
        met = [tuple(sorted((a, b))) for got in bucket.rows(found) for a, b in zip(got[0].tolist(), got[1].tolist())]
        assert len(met) == len({*met}) == wanted
