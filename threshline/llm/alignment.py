"""Alignment of two texts along a chain of common seeds: what lies between them by edit distance, the ends as far as they pay."""

from __future__ import annotations

#: Share of a passage that must be equal; at the ends an edit costs as many characters as this share allows for it.
IDENTITY = 0.8
#: An end is given up when it has lost so many edits against its best place.
DROP = 3


def common(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters from a[i] and b[j] on, at most ``most``."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step >>= 1
    return n


def equal_before(a: str, i: int, b: str, j: int) -> int:
    """Equal characters right before a[i] and b[j]."""
    n, step = 0, 256
    while n < min(i, j):
        low = min(step, min(i, j) - n)
        got = common(a[i - n - low : i - n][::-1], 0, b[j - n - low : j - n][::-1], 0, low)
        n += got
        if got < low:
            break
        step *= 4
    return n


def edits(a: str, b: str) -> int:
    """Edit distance: a column of the matrix is the bits of two integers (Myers), one step a character of ``b``."""
    n = common(a, 0, b, 0, min(len(a), len(b)))
    a, b = a[n:], b[n:]
    n = common(a[::-1], 0, b[::-1], 0, min(len(a), len(b)))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        at = places.get(c, 0)
        zero = (((at & up) + up) ^ up) | at | down
        right, left = down | ~(zero | up) & full, up & zero
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right = right << 1 | 1
        up = (left << 1 | ~(zero | right)) & full
        down = right & zero & full
    return distance


def extended(a: str, b: str, identity: float = IDENTITY, drop: int = DROP) -> tuple[int, int, int]:
    """(characters of a, of b, edits) of the best common beginning.

    Furthest places by diagonal, one edit after the other.  An edit pays when it brings 1 / (1 - identity) characters.
    """
    price = round(2 / (1 - identity))
    n = common(a, 0, b, 0, min(len(a), len(b)))
    best, result, reach, done = 2 * n, (n, n, 0), {0: n}, 0
    while reach:
        done += 1
        ahead: dict[int, int] = {}
        for d, i in reach.items():  # d = i - j
            for e, x in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):
                if x <= len(a) and x - e <= len(b) and x > ahead.get(e, -1):
                    ahead[e] = x
        slid = []
        for d, i in ahead.items():
            j = i - d
            most = min(len(a) - i, len(b) - j)
            stop = i + min(most, 8)  # most runs are short
            while i < stop and a[i] == b[i - d]:
                i += 1
            if i == stop and most > 8:
                i += common(a, i, b, i - d, most - 8)
            slid.append((2 * i - d - price * done, -d, i))
        if not slid:
            break
        score, d, i = max(slid)
        if score > best:
            best, result = score, (i, i + d, done)
        reach = {-d: i for score, d, i in slid if score > best - drop * price}
    return result


def grown(texts, size: int) -> tuple[int, int, int]:
    """``extended`` over windows of the texts that grow until the end of the passage lies well within them."""
    window = 256
    while True:
        a, b = texts(window)
        found = extended(a, b)
        if window >= size or max(found[:2]) < window // 2:
            return found
        window *= 4


def aligned(a: str, b: str, path: list[tuple[int, int]], k: int, most: int, identity: float = IDENTITY) -> list[tuple[int, int, int, int, int, int]]:
    """(start in a, end, start in b, end, edits, seeds) of the passages of one chain of seeds at (place in a, place in b).

    A chain is cut where more than ``most`` edits lie between two seeds, and a part that is less alike than ``identity``
    once more where most edits lie, so that no like part is lost with an unlike one.  Ends reach to the next seed at most.
    """
    between = []
    for (x, y), (u, v) in zip(path, path[1:]):
        same = u - x == v - y and a[x:u] == b[y:v]
        between.append(0 if same else edits(a[x:u], b[y:v]) if abs((u - x) - (v - y)) <= most else most + 1)
    cuts = [n for n, e in enumerate(between, 1) if e > most]
    parts = list(zip([0, *cuts], [*cuts, len(path)]))[::-1]
    out = []
    while parts:
        first, last = parts.pop()
        (x, y), (u, v) = path[first], (path[last - 1][0] + k, path[last - 1][1] + k)
        low = (path[first - 1][0] + k, path[first - 1][1] + k) if first else (0, 0)
        top = path[last] if last < len(path) else (len(a), len(b))
        back = ahead = (0, 0, 0)
        if x > low[0] and y > low[1]:
            back = grown(lambda n: (a[max(low[0], x - n) : x][::-1], b[max(low[1], y - n) : y][::-1]), max(x - low[0], y - low[1]))
        if u < top[0] and v < top[1]:
            ahead = grown(lambda n: (a[u : min(top[0], u + n)], b[v : min(top[1], v + n)]), max(top[0] - u, top[1] - v))
        s, e, t, f = x - back[0], u + ahead[0], y - back[1], v + ahead[1]
        changed = sum(between[first : last - 1]) + back[2] + ahead[2]
        if changed > (1 - identity) * max(e - s, f - t) and last - first > 1:
            worst = max(range(first, last - 1), key=between.__getitem__) + 1
            parts += [(worst, last), (first, worst)]
        else:
            out.append((s, e, t, f, changed, last - first))
    return out
