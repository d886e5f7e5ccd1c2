import random
from collections import Counter, defaultdict

import numpy as np

from threshline.llm.packing import B, K1, Index, fill, fill_report, pack_texts
from threshline.llm.tokenizer import encode_corpus


def test_index_against_plain_bm25():
    rnd = random.Random(2)
    texts = [Counter(rnd.choices(range(30), k=rnd.randint(1, 20))) for _ in range(25)]
    index = Index([np.array(sorted(t)) for t in texts], [np.array([t[k] for k in sorted(t)]) for t in texts])
    average = sum(map(lambda t: sum(t.values()), texts)) / len(texts)
    for q in range(25):
        for d in range(25):
            want = 0.0
            for term in texts[q]:
                n = sum(term in t for t in texts)
                idf = max(0.0, np.log((25 - n + 0.5) / (n + 0.5)))
                f = texts[d][term]
                want += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * sum(texts[d].values()) / average))
            assert abs(index.scores(q)[d] - want) < 1e-9


def test_fill_holds_every_item_once():
    rnd = random.Random(3)
    sizes = np.array([rnd.randint(1, 100) for _ in range(400)])
    boxes = fill(sizes, None, 100)
    assert sorted(i for b in boxes for i in b) == list(range(400)) and all(sizes[b].sum() <= 100 for b in boxes)
    assert len(boxes) <= -(-sizes.sum() // 100) * 1.05 + 1  # large items leave gaps that no item fills


def test_neighbours_share_a_container(spark):
    words = ["alpha beta gamma delta ", "one two three four ", "red green blue white "]
    rows = [(k, words[k % 3] * 3, "x") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, container_id STRING")
    boxes = defaultdict(set)
    for r in pack_texts(docs, capacity=60).collect():
        boxes[r.container_id].add(r.doc_id % 3)
    assert sum(len(b) == 1 for b in boxes.values()) >= len(boxes) - 2


def test_table(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice(["merge", "branch", "review", "日本", "x1"]) for _ in range(rnd.choice([1, 20, 60, 300])))) for k in range(120)]
    rows += [(900, None), (901, ""), (902, "a" * 3000), (903, "b " * 700), (904, "hot"), (904, "hot"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    packed = pack_texts(docs, capacity=256, shard_texts=40).collect()
    sizes = Counter()
    for r in encode_corpus(docs).collect():
        sizes[r.doc_id] += len(r.ids)
    parts, boxes = defaultdict(list), Counter()
    for r in packed:
        parts[r.doc_id].append((r.first_token, r.n_tokens))
        boxes[r.container_id] += r.n_tokens
    assert max(boxes.values()) <= 256 and {k: sum(n for _, n in v) for k, v in parts.items()} == {k: n for k, n in sizes.items() if n}
    for key, pieces in parts.items():
        pieces.sort()
        if sizes[key] <= 256 and key != 904:
            assert len(pieces) == 1
        elif key != 904:
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 1
    report = fill_report(pack_texts(docs, capacity=256, shard_texts=40), 256).first()
    assert report.tokens == sum(sizes.values()) and report.containers <= report.least_containers * 1.05 + 1
    assert pack_texts(spark.createDataFrame([], "doc_id LONG, text STRING")).collect() == []
