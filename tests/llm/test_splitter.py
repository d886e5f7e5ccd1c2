from hypothesis import given, settings
from hypothesis import strategies as st

from threshline.llm.splitter import oversized_report, split_oversized, split_text

lines = st.lists(st.one_of(st.just("@@ -1 +1 @@"), st.just(""), st.just("+"), st.text(alphabet="ab \r日", max_size=90)), min_size=1, max_size=40)


@settings(max_examples=400, deadline=None)
@given(lines)
def test_pieces(parts):
    text = "\n".join(parts)
    limit, overlap = 60, 10
    if len(text) <= limit:
        return
    pieces, cut = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in pieces)
    ends = [e for _, e in pieces]
    assert ends == sorted(set(ends))
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        assert start == max(0, end - overlap)
        if text[end - 1] != "\n":  # cut inside a line only where no piece can hold it
            line = text.count("\n", 0, end)
            assert line + 1 in cut and len(text.split("\n")[line]) >= limit - overlap
    long = {n for n, x in enumerate(text.split("\n"), 1) if len(x) > limit - overlap}
    assert long <= set(cut)


def test_boundaries_by_strength():
    text = "x" * 20 + "\n" + "y" * 20 + "\n\n" + "z" * 20 + "\n@@ 1\n" + "w" * 20
    assert text[: split_text(text, 80, 10)[0][0][1]].endswith("z\n")


def test_report(spark):
    long = "+" + "x" * 3800
    rows = [(1, "a\n" * 2500, 1), (2, "+b\n" + long + "\n" + "c\n" * 200, 1), (3, None, 1), (4, "", 1), (5, "d" * 4000, 1), (6, "日" * 4001, 1), (2, "+b\n" + long + "\n" + "c\n" * 200, 1)]
    df = spark.createDataFrame(rows, "diff_id LONG, diff STRING, piece_no INT")
    pieces = split_oversized(df)
    assert sorted(tuple(r) for r in oversized_report(pieces).collect()) == [(1, 0), (2, 0), (2, 0), (2, 2), (2, 2), (6, 0), (6, 1)]
    for key, text in ((1, rows[0][1]), (6, rows[5][1])):
        found = sorted((r.piece_no, r.start_pos, r.piece) for r in pieces.where(f"diff_id = {key}").collect())
        assert all(len(p) <= 4000 and text[s - 1 : s - 1 + len(p)] == p for _, s, p in found)
        assert all(b[2].startswith(a[2][-200:]) for a, b in zip(found, found[1:]))


def test_no_short_piece_before_a_line_that_is_cut_anyway():
    pieces, cut = split_text("\n" + "a" * 9000)
    assert cut == [2] and all(e - s >= 2000 for s, e in pieces) and all(b[0] == a[1] - 200 for a, b in zip(pieces, pieces[1:]))
    pieces, cut = split_text("ab\n" + "c" * 3798)  # here the short part spares the line
    assert cut == [] and [e for _, e in pieces] == [3, 3801]
