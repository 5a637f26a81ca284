"""Simple rings around the inside of rings that cross themselves, strip by strip.

A polygon's edges lie in upright strips whose bounds are no coordinate's. Inside a strip each edge is cut where others cross it.
At every point the edges around it have the inside and the outside between them by turns, so an edge's inner side changes from
cut to cut by the edges that it passes, and the side on which it enters the strip follows from the edges below. Rings that stay
in a strip are closed there; the others leave pieces, which are joined at the strips' bounds. The work follows the crossings,
of which a task holds those of a strip.

Coordinates are whole numbers here, so that all tests of sides are exact.
"""

from __future__ import annotations

import numpy as np

#: Pairs of edges that are compared at once; crossings nearer than this on an edge are one point.
PAIRS, NEAR = 1_000_000, 0.01


def _exact(a, b):
    """a * b and its rounding error."""
    p = a * b
    s, t = a * 134217729.0, b * 134217729.0
    ah, bh = s - (s - a), t - (t - b)
    return p, ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)


def _side(x0, y0, x1, y1, px, py, doubtful):
    """Above 0: p is left of the line from 0 to 1, below: right, 0: on it. The sign is exact."""
    a, b, c, d = x1 - x0, py - y0, y1 - y0, px - x0
    p, q = a * b, c * d
    out = p - q
    doubt = np.flatnonzero(np.abs(out) <= doubtful)
    if len(doubt):
        (p, e), (q, f) = _exact(a[doubt], b[doubt]), _exact(c[doubt], d[doubt])
        out[doubt] = (p - q) + (e - f)
    return out


def _height(s, x):
    return s["yl"] + (x - s["xl"]) * ((s["yr"] - s["yl"]) / np.where(s["xr"] > s["xl"], s["xr"] - s["xl"], 1.0))


def near(s: dict, left: float, right: float):
    """i, j: the pairs of edges whose boxes inside the strip touch, in lots of PAIRS at most (or one edge's)."""
    upright = s["xl"] == s["xr"]
    a, b = _height(s, np.maximum(s["xl"], left)), np.where(upright, s["yr"], _height(s, np.minimum(s["xr"], right)))
    low, high = np.minimum(a, b) - 1, np.maximum(a, b) + 1  # heights are rounded
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    at = np.arange(len(low))
    many = np.searchsorted(low, high, side="right") - at - 1
    ends = np.cumsum(many)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        m = many[first:last]
        i = np.repeat(at[first:last], m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        i, j = order[i], order[j]
        met = (s["xl"][i] <= s["xr"][j]) & (s["xl"][j] <= s["xr"][i])
        yield np.minimum(i, j)[met], np.maximum(i, j)[met]
        first = last


def _sides(s, i, j):
    """Where the ends of j lie by i, and those of i by j."""
    a, b = ([s[c][k] for c in ("xl", "yl", "xr", "yr")] for k in (i, j))
    most = 1e-15 * (s["xr"].max() - s["xl"].min()) * (max(s["yl"].max(), s["yr"].max()) - min(s["yl"].min(), s["yr"].min()))
    return _side(*a, b[0], b[1], most), _side(*a, b[2], b[3], most), _side(*b, a[0], a[1], most), _side(*b, a[2], a[3], most)


def touches(s: dict, left: float, right: float):
    """edge, x, y: ends of edges that lie on another edge, not at its ends."""
    out = []
    for i, j in near(s, left, right):
        bl, br, al, ar = _sides(s, i, j)
        for on, end, v, x, y in ((i, j, bl, "xl", "yl"), (i, j, br, "xr", "yr"), (j, i, al, "xl", "yl"), (j, i, ar, "xr", "yr")):
            k = np.flatnonzero(v == 0)
            e, px, py = on[k], s[x][end[k]], s[y][end[k]]
            past = (px > s["xl"][e]) | ((px == s["xl"][e]) & (py > s["yl"][e]))
            ahead = (px < s["xr"][e]) | ((px == s["xr"][e]) & (py < s["yr"][e]))
            k = past & ahead & (px > left) & (px < right)
            out.append((s["id"][e[k]], px[k], py[k]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.array([])] * 3


def _crossings(s, left, right):
    """i, j, their places on both (from 0 to 1), x, y, whether j comes from i's right, of all crossings in the strip."""
    out = [[np.array([], int)] * 2 + [np.array([])] * 4 + [np.array([], bool)]]
    for i, j in near(s, left, right):
        bl, br, al, ar = _sides(s, i, j)
        k = (bl * br < 0) & (al * ar < 0)
        i, j, bl, br, al, ar = i[k], j[k], bl[k], br[k], al[k], ar[k]
        ti, tj = al / (al - ar), bl / (bl - br)
        x, y = (s[f"{c}l"][i] + ti * (s[f"{c}r"][i] - s[f"{c}l"][i]) for c in "xy")
        k = (x > left) & (x < right)
        out.append([v[k] for v in (i, j, ti, tj, np.rint(x), np.rint(y), bl < 0)])
    return [np.concatenate(c) for c in zip(*out)]


def _united(n, near_):
    """Each of n things' least one that it is the same as. near_: pairs of the same ones."""
    up = np.arange(n)
    while True:
        a, b = up[near_[0]], up[near_[1]]
        if (a == b).all():
            return up
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]


def pieces(s: dict, left: float, right: float):
    """The rings and pieces of rings inside the strip: start and stop (of each one's points), x, y (the points), and for pieces
    from_edge, from_right, to_edge, to_right, the edges on which they come and go, and whether by the right bound; of rings
    the edges are -1. s: id, xl, yl, xr, yr of edges that touch each other at ends only. The inside is on the left."""
    m = len(s["id"])
    i, j, ti, tj, x, y, rising = _crossings(s, left, right)
    n = len(i)
    dx, dy = s["xr"] - s["xl"], s["yr"] - s["yl"]
    # points: crossings, then ends of edges, then where edges come and go
    starts, stops = s["xl"] > left, s["xr"] < right
    ends, which = np.unique(np.stack([np.concatenate([s["xl"][starts], s["xr"][stops]]), np.concatenate([s["yl"][starts], s["yr"][stops]])]), axis=1, return_inverse=True)
    which = which.ravel() + n
    in_, out_ = np.empty(m, int), np.empty(m, int)
    in_[starts], out_[stops] = which[: starts.sum()], which[starts.sum() :]
    gates = n + ends.shape[1]
    in_[~starts] = gates + np.arange((~starts).sum())
    out_[~stops] = gates + (~starts).sum() + np.arange((~stops).sum())
    px, py = np.concatenate([x, ends[0]]), np.concatenate([y, ends[1]])
    # each edge's points in order
    edge = np.concatenate([np.arange(m), i, j, np.arange(m)])
    t = np.concatenate([np.full(m, -1.0), ti, tj, np.full(m, 2.0)])
    point = np.concatenate([in_, np.arange(n), np.arange(n), out_])
    order = np.argsort(t)
    order = order[np.argsort(edge[order].astype(np.uint16 if m < 65536 else np.int64), kind="stable")]
    found = order
    edge, t, point = edge[order], t[order], point[order]
    same = np.flatnonzero((edge[1:] == edge[:-1]) & ((t[1:] - t[:-1]) * np.hypot(dx, dy)[edge[1:]] <= NEAR) & (point[1:] < n) & (point[:-1] < n))
    if len(same):  # three edges through a point: the third pair's crossing is there too
        a, b = point[same], point[same + 1]
        pairs = i * m + j
        sorted_ = np.argsort(pairs)
        e = edge[same]
        o, p = np.where(i[a] == e, j[a], i[a]), np.where(i[b] == e, j[b], i[b])
        code = np.minimum(o, p) * m + np.maximum(o, p)
        at = np.minimum(np.searchsorted(pairs[sorted_], code), n - 1)
        third = sorted_[at]
        known = pairs[third] == code
        up = _united(n, (np.concatenate([a, a[known]]), np.concatenate([b, third[known]])))
        point = np.where(point < n, up[np.minimum(point, n - 1)], point)
        keep = np.concatenate([[True], (edge[1:] != edge[:-1]) | (point[1:] != point[:-1])])
        edge, point = edge[keep], point[keep]
    # parts of edges, from one point to the next, and the order of their ends around each point
    whole = np.flatnonzero(edge[1:] == edge[:-1])
    own, u, v = edge[whole], point[whole], point[whole + 1]
    k = len(own)
    turn = np.arctan2(dy, dx)
    turn = np.unique(np.concatenate([turn, turn - np.pi]), return_inverse=True)[1]  # edges run to the right or up: -pi/2 < turn <= pi/2
    at = np.concatenate([u, v])
    ranked = lambda h: h[np.argsort(at[h] * (2 * m) + np.where(h < k, turn[own[h % k]], turn[m + own[h % k]]))]
    if len(same):
        order = ranked(np.arange(2 * k))
    else:  # the four ends around a crossing are known
        where = np.empty(len(found), int)
        where[found] = np.arange(len(found))
        a, b = where[m : m + n] - i, where[m + n : m + 2 * n] - j
        four = np.stack([a, np.where(rising, b, k + b - 1), k + a - 1, np.where(rising, k + b - 1, b)], axis=1)
        order = np.concatenate([four.ravel(), ranked(np.flatnonzero(at >= n))])
    # of each point, where its ends begin in that order, and how many they are
    size = np.bincount(at)
    begin = np.cumsum(size) - size
    place = np.empty(2 * k, int)
    place[order] = np.arange(2 * k)
    rank = place - begin[at]
    # whether the inside is above an edge's first part: by the edges below where it enters, or below its first part
    above = np.empty(m, bool)
    comes = np.flatnonzero(~starts)
    above[comes[np.argsort(_height({c: s[c][comes] for c in ("xl", "yl", "xr", "yr")}, left))]] = np.arange(len(comes)) % 2 == 0
    parts = np.concatenate([[True], own[1:] != own[:-1]])
    opening = np.flatnonzero(parts)
    upright = dx == 0
    slope = dy / np.where(upright, 1.0, dx)
    for f in opening[starts[own[opening]]]:
        e = own[f]
        tip = v[f] < gates
        ax, ay = s["xl"][e], s["yl"][e]
        bx, by = (px[v[f]], py[v[f]]) if tip else (right, ay + (right - ax) * slope[e])
        mx, my = (ax + bx) / 2, (ay + by) / 2 if upright[e] else ay + (bx - ax) / 2 * slope[e]
        over = (s["xl"] < mx) & (mx <= s["xr"]) if upright[e] else (s["xl"] <= mx) & (mx < s["xr"])
        over[e] = False
        below = np.count_nonzero(s["yl"][over] + (mx - s["xl"][over]) * slope[over] < my)
        above[e] = (below % 2 == 1) == bool(upright[e])
    # from part to part the side changes if an even number of steps lies between the two ends around the point
    flips = np.zeros(k, int)
    later = np.flatnonzero(~parts)
    flips[later] = (rank[later] - rank[k + later - 1]) % 2 == 0
    total = np.cumsum(flips)
    along = above[own] ^ ((total - np.repeat(total[opening], np.diff(np.append(opening, k)))) % 2 == 1)
    # a part that comes to a point goes on to the next one clockwise
    tail, head = np.where(along, u, v), np.where(along, v, u)
    arrives = np.where(along, k + np.arange(k), np.arange(k))
    back = rank[arrives] - 1
    onward = order[begin[head] + np.where(back < 0, size[head] - 1, back)]
    ahead = np.where(onward < k, onward, onward - k)
    closed = head < gates
    if (along[ahead] != (onward < k))[closed].any():
        raise ArithmeticError("edges around a point that don't lie by turns")
    comes = np.flatnonzero(tail >= gates)
    one = now = comes
    while len(now):  # a piece's last part goes on to its first, so that it is a ring too
        ended = ~closed[now]
        ahead[now[ended]] = one[ended]
        one, now = one[~ended], ahead[now[~ended]]
    # rings by their least part and the distance to it, in doubled steps; pieces' first parts have the least numbers
    small = np.int32 if k < 2**30 else np.int64
    least, far, step, reach = np.empty(k, small), np.zeros(k, small), ahead.astype(small), 1
    least[np.concatenate([comes, np.flatnonzero(tail < gates)])] = np.arange(k)
    while True:
        least2 = least[step]
        better = np.flatnonzero(least2 < least)
        if not len(better):
            break
        far[better] = far[step[better]] + reach
        least[better] = least2[better]
        step, reach = step[step], 2 * reach
    lengths = np.bincount(least, minlength=k)
    base = np.cumsum(lengths) - lengths
    placed = np.empty(k, int)
    placed[base[least] + (lengths[least] - far) % lengths[least]] = np.arange(k)
    ring = least[placed]
    opens = tail[placed] >= gates
    begins = opens | np.concatenate([[True], ring[1:] != ring[:-1]])
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], k)
    piece = opens[start]
    one, end = placed[start], placed[stop - 1]
    x, y = (np.append(c, 0.0)[np.minimum(tail[placed], len(c))] for c in (px, py))
    name = lambda e: np.where(piece, s["id"][own[e]], -1)
    return start + piece, stop, x, y, name(one), ~along[one], name(end), along[end]


def corners(start, stop, x, y, least: float):
    """The rings without repeated points and without those on the line between their neighbours: each ring's number and size, and
    x, y of all. Of points beside each other only every other one goes at a time, so that a point whose neighbour is
    very near isn't lost with it. Rings of fewer than three are left out."""
    size = stop - start
    ring = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(ring)) + np.repeat(start - (np.cumsum(size) - size), size)
    x, y = x[at], y[at]
    done = []
    while len(ring):
        k = np.arange(len(ring))
        first = np.concatenate([[True], ring[1:] != ring[:-1]])
        last = np.append(first[1:], True)
        before, after = k - 1, k + 1
        before[first], after[last] = k[last], k[first]
        dx, dy, ex, ey = x - x[before], y - y[before], x[after] - x, y[after] - y
        flat = np.abs(dx * ey - dy * ex) <= least * (np.abs(dx) + np.abs(dy) + np.abs(ex) + np.abs(ey))
        rest = np.zeros(int(ring[-1]) + 1, bool)
        rest[ring[flat]] = True
        rest = rest[ring]
        done.append((ring[~rest], x[~rest], y[~rest]))
        head = np.maximum.accumulate(np.where(first | ~flat, np.where(flat, k, k + 1), 0))  # where a row of flat points begins
        go = flat & ((k - head) % 2 == 0)
        go[last] &= first[last] | ~go[first]
        keep = rest & ~go
        ring, x, y = ring[keep], x[keep], y[keep]
    if done:
        ring, x, y = (np.concatenate(c) for c in zip(*done))
    size = np.bincount(ring, minlength=1)
    keep = size[ring] > 2
    ring, x, y = ring[keep], x[keep], y[keep]
    number = ring[np.concatenate([[True], ring[1:] != ring[:-1]])] if len(ring) else ring
    return number, size[number], x, y
