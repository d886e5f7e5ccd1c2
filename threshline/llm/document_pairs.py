"""Passages of every pair of documents in a bucket that have a common seed: whole arrays of pairs are aligned at once.

Equal texts are aligned once, whoever holds them.  Most pairs have their common seeds on one diagonal with nothing changed
between; these are checked and extended as array rows.  All others are chained one by one (``pair_passages``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from threshline.llm.alignment import DROP, IDENTITY

#: Common seeds of pairs, pairs, and pairs of holders that are array rows at once; they bound memory and change no result.
MATCHES, ROWS, OUT = 400_000, 20_000, 200_000
#: Edits an end may take as an array row; longer ends are aligned one by one.
ROUNDS = 12
#: Characters compared at once.
WIDTH = 64


def equal_run(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Equal characters from codes[a] and codes[b] on, in the direction of ``step``, at most ``most``."""
    n = np.zeros(len(a), np.int64)
    live, width = np.flatnonzero(most > 0), 4
    while len(live):
        ahead = step[live, None] * (n[live, None] + np.arange(width))
        equal = codes[a[live, None] + ahead] == codes[b[live, None] + ahead]
        run = np.where(equal.all(1), width, equal.argmin(1))
        n[live] = np.minimum(n[live] + run, most[live])
        live = live[(run == width) & (n[live] < most[live])]
        width = min(WIDTH, 4 * width)
    return n


def extended_rows(codes: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """``alignment.extended`` of many pairs of ends: (characters of a, of b, edits, whether ROUNDS were too few)."""
    price = round(2 / (1 - IDENTITY))
    i = equal_run(codes, a, b, np.minimum(size_a, size_b), step)
    j, edits, best = i.copy(), np.zeros(len(i), np.int64), 2 * i
    live, reach = np.arange(len(i)), i[:, None].copy()  # furthest place in a by diagonal, -1: none
    for done in range(1, ROUNDS + 1):
        if not len(live):
            break
        d = np.arange(2 * done + 1) - done
        before = np.full((len(live), 2 * done + 3), -2)
        before[:, 2:-2] = np.where(reach < 0, -2, reach)
        top_a, top_b = size_a[live, None], size_b[live, None]
        x = np.full((len(live), 2 * done + 1), -1)
        for came in (before[:, 1:-1] + 1, before[:, :-2] + 1, before[:, 2:]):
            x = np.maximum(x, np.where((came >= 0) & (came <= top_a) & (came - d <= top_b), came, -1))
        row, cell = np.nonzero(x >= 0)
        at, of = x[row, cell], live[row]
        to = at - d[cell]
        x[row, cell] += equal_run(codes, a[of] + step[of] * at, b[of] + step[of] * to, np.minimum(size_a[of] - at, size_b[of] - to), step[of])
        score = np.where(x >= 0, 2 * x - d - price * done, np.iinfo(np.int64).min)
        first = score.argmax(1)
        top = score[np.arange(len(live)), first]
        better = top > best[live]
        won = live[better]
        best[won], i[won], edits[won] = top[better], x[better, first[better]], done
        j[won] = i[won] - d[first[better]]
        reach = np.where((x >= 0) & (score > best[live, None] - DROP * price), x, -1)
        stay = (reach >= 0).any(1)
        live, reach = live[stay], reach[stay]
    over = np.zeros(len(i), bool)
    over[live] = True
    return i, j, edits, over


class Bucket:
    """Documents of two sides, by row: their texts, their common seeds, and which side or sides each is on."""

    def __init__(self, keys: np.ndarray, texts: list[str], left: np.ndarray, right: np.ndarray, seeds_of: np.ndarray, seeds: np.ndarray, places: np.ndarray):
        """``keys`` are numbers of the documents; ``seeds_of`` is the row that a seed and its packed place belong to."""
        self.keys, self.left, self.right = keys, left, right
        self.texts = sorted(set(texts))  # their order gives the orientation of a pair
        number = {t: n for n, t in enumerate(self.texts)}
        self.text_of = np.array([number[t] for t in texts], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        gap = "\0" * WIDTH
        self.codes = np.frombuffer((gap + "".join(self.texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes + WIDTH
        owner = self.text_of[seeds_of]
        order = np.lexsort((places, owner, seeds))
        seed, owner, at = seeds[order], owner[order], places[order]
        fresh = np.concatenate([[True], (np.diff(seed) != 0) | (np.diff(owner) != 0) | (np.diff(at) != 0)]) if len(seed) else np.empty(0, bool)
        self.seed, self.owner, self.at = seed[fresh], owner[fresh], at[fresh]
        self._lists: dict[int, dict[int, list[int]]] = {}
        by_text = np.argsort(self.owner, kind="stable")
        self._by_text = by_text, np.searchsorted(self.owner[by_text], np.arange(len(self.texts) + 1))

    def listed(self, text: int) -> tuple[str, dict[int, list[int]]]:
        """A text and the packed places of each of its seeds."""
        if text not in self._lists:
            order, cut = self._by_text
            mine = order[cut[text] : cut[text + 1]]
            found = self._lists[text] = {}
            for s, at in zip(self.seed[mine].tolist(), self.at[mine].tolist()):
                found.setdefault(s, []).append(at)
        return self.texts[text], self._lists[text]

    def matches(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, greater text, place, place, repeated) of the common seeds of two texts, in order; all of a text come together.

        ``repeated`` says that one of both texts has the seed more than once.
        """
        if not len(self.seed):
            return
        new = np.flatnonzero(np.concatenate([[True], (np.diff(self.seed) != 0) | (np.diff(self.owner) != 0)]))
        seed, owner, place = self.seed[new], self.owner[new], self.at[new] >> 32
        many = np.diff(np.append(new, len(self.seed))) > 1
        first = np.flatnonzero(np.concatenate([[True], np.diff(seed) != 0]))
        size = np.diff(np.append(first, len(seed)))
        after = np.repeat(first + size, size) - np.arange(len(seed)) - 1  # holders of the same seed with a greater text
        n_texts = len(self.texts)
        has_left, has_right = np.bincount(self.text_of[self.left], minlength=n_texts) > 0, np.bincount(self.text_of[self.right], minlength=n_texts) > 0
        order = np.argsort(owner, kind="stable")
        order = order[after[order] > 0]
        ends = np.flatnonzero(np.append(np.diff(owner[order]) != 0, True)) + 1 if len(order) else []
        total, low = np.cumsum(after[order]), 0
        for end, following in zip(ends, [*ends[1:], None]):
            if following is not None and total[following - 1] - (total[low - 1] if low else 0) <= MATCHES:
                continue
            rows, low = order[low:end], end
            n = after[rows]
            mine = np.repeat(rows, n)
            theirs = mine + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            u, v = owner[mine], owner[theirs]
            met = (has_left[u] & has_right[v]) | (has_right[u] & has_left[v])
            mine, theirs, u, v = mine[met], theirs[met], u[met], v[met]
            order_ = np.lexsort((place[mine], u * n_texts + v))
            mine, theirs = mine[order_], theirs[order_]
            yield u[order_], v[order_], place[mine], place[theirs], many[mine] | many[theirs]

    def passages(self, least: int, k: int, pair_passages: Callable) -> Iterator[np.ndarray]:
        """Columns (text, other text, start, end, start there, end there, edits, seeds) of the passages of two texts or one."""
        same = np.arange(len(self.texts))
        n_seeds = np.bincount(np.unique(np.stack([self.owner, self.at >> 32]), axis=1)[0], minlength=len(same))
        nought = np.zeros_like(same)
        yield np.array([same, same, nought, self.sizes, nought, self.sizes, nought, n_seeds])
        for u, v, x, y, repeated in self.matches():
            if not len(u):
                continue
            new = np.flatnonzero(np.concatenate([[True], (np.diff(u) != 0) | (np.diff(v) != 0)]))
            last = np.append(new[1:], len(u)) - 1
            straight = (np.minimum.reduceat(x - y, new) == np.maximum.reduceat(x - y, new)) & ~np.logical_or.reduceat(repeated, new)
            for lo in range(0, len(new), ROWS):
                begin, end, simple = new[lo : lo + ROWS], last[lo : lo + ROWS], straight[lo : lo + ROWS].copy()
                one, two = u[begin], v[begin]
                at = np.flatnonzero(simple)
                a, b = x[begin[at]], y[begin[at]]
                need = x[end[at]] + k - a
                fits = (a + need <= self.sizes[one[at]]) & (b + need <= self.sizes[two[at]])  # a repeated id has several texts
                need = np.where(fits, need, 0)
                held = fits & (equal_run(self.codes, self.starts[one[at]] + a, self.starts[two[at]] + b, need, np.ones(len(at), np.int64)) == need)
                simple[at[~held]] = False
                at, a, b, need = at[held], a[held], b[held], need[held]
                from_a, from_b, n = self.starts[one[at]], self.starts[two[at]], len(at)
                i, j, edits, over = extended_rows(
                    self.codes, np.concatenate([from_a + a - 1, from_a + a + need]), np.concatenate([from_b + b - 1, from_b + b + need]),
                    np.concatenate([a, self.sizes[one[at]] - a - need]), np.concatenate([b, self.sizes[two[at]] - b - need]), np.repeat([-1, 1], n),
                )
                long = over[:n] | over[n:]
                simple[at[long]] = False
                s, e, t, f, changed = a - i[:n], a + need + i[n:], b - j[:n], b + need + j[n:], edits[:n] + edits[n:]
                good = ~long & (np.minimum(e - s, f - t) >= least) & (changed <= (1 - IDENTITY) * np.maximum(e - s, f - t))
                yield np.array([c[good] for c in (one[at], two[at], s, e, t, f, changed, (end - begin + 1)[at])])
                rest = [(p, q, *got) for p, q in zip(one[~simple].tolist(), two[~simple].tolist()) for got in pair_passages(self.listed(p), self.listed(q), least, k)]
                if rest:
                    yield np.array(rest, np.int64).T

    def rows(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, other row, number of the passage) of the documents that hold the passages of two texts."""
        one, two = found[0], found[1]
        both = bool((self.left & self.right).any())  # one side met with itself
        for mine, theirs in [(self.left, self.right)] if both else [(self.left, self.right), (self.right, self.left)]:
            sides = []
            for rows, of in ((np.flatnonzero(mine), one), (np.flatnonzero(theirs), two)):
                rows = rows[np.argsort(self.text_of[rows], kind="stable")]
                low, high = (np.searchsorted(self.text_of[rows], of, side) for side in ("left", "right"))
                sides.append((rows, low, high - low))
            (rows_a, low_a, n_a), (rows_b, low_b, n_b) = sides
            if mine is self.right:  # two holders of one text meet once
                n_a = np.where(one == two, 0, n_a)
            ends = np.cumsum(n_a * n_b)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, OUT):
                place = np.arange(lo, min(lo + OUT, int(ends[-1])))
                which = np.searchsorted(ends, place, "right")
                k = place - (ends - n_a * n_b)[which]
                a, b = rows_a[low_a[which] + k // n_b[which]], rows_b[low_b[which] + k % n_b[which]]
                keep = self.keys[a] != self.keys[b]
                if both:
                    keep &= (one[which] != two[which]) | (a < b)
                yield a[keep], b[keep], which[keep]
