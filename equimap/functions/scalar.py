"""Column expressions: normalisation, classification, travel times, kernels. Nothing here leaves whole-stage codegen
except where a regular expression is the feature."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def minmax(x: Column, lo: Column, hi: Column, eps: float = 1e-12) -> Column:
    return F.when(hi - lo < eps, F.lit(0.0)).otherwise((x - lo) / F.when(hi - lo < eps, F.lit(1.0)).otherwise(hi - lo))


def minmax_eps(x: Column, lo: Column, hi: Column, reverse: bool = False) -> Column:
    return (hi - x if reverse else x - lo) / (hi - lo + 1e-9)


def zscore_clip(x: Column, mean: Column, std: Column, limit: float = 3.5) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), (x - mean) / (std + 1e-9)))


def percentile_norm(x: Column, p_lo: Column, p_hi: Column, lo: Column, hi: Column) -> Column:
    """Between two percentiles, clipped; between the extremes where the percentiles meet."""
    wide = p_hi - p_lo >= 1e-9
    v = F.when(wide, (x - p_lo) / (p_hi - p_lo + 1e-9)).otherwise((x - lo) / (hi - lo + 1e-9))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def boxcox(y: Column, lam: float, eps: float = 1e-4) -> Column:
    v = F.greatest(y, F.lit(eps))
    return F.log(v) if abs(lam) < 1e-8 else (F.pow(v, F.lit(lam)) - 1) / lam


def boxcox_inverse(y: Column, lam: float, eps: float = 1e-4) -> Column:
    v = F.exp(y) if abs(lam) < 1e-8 else F.pow(F.greatest(y * lam + 1, F.lit(1e-9)), F.lit(1 / lam))
    return F.greatest(v - eps, F.lit(0.0))


def boxcox_likelihood(n: int, sum_log: float, variance: float, lam: float) -> float:
    """Log-likelihood of the exponent from three sums."""
    return (lam - 1) * sum_log - n / 2 * math.log(max(variance, 1e-300))


def log_target(y: Column, p95: Column, eps: float = 1e-6) -> Column:
    return F.log(F.least(y, p95) + eps)


def first_match(text: Column, rules: list[tuple[list[str], str]], default: Column | str | None = None) -> Column:
    """Label of the first rule of which a word is in the text."""
    out = default if isinstance(default, Column) else F.lit(default)
    for words, label in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def lookup(key: Column, pairs: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(pairs.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def canonical_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), r"^([+-]?\d+)\.0+$", "$1")


def clean_name(c: Column) -> Column:
    """Full-width brackets to ASCII, white space off, other symbols off."""
    return F.regexp_replace(F.translate(c, "（）　 \t\n", "()"), r"[^\p{L}\p{N}()]", "")


def family(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.get(F.split(c, "_", 2), 0)


def point_of_wkt(c: Column) -> tuple[Column, Column]:
    num = r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    pat = rf"(?i)^\s*POINT\s*\(\s*{num}\s+{num}\s*\)\s*$"
    return tuple(F.regexp_extract(c, pat, i).try_cast("double") for i in (1, 2))


def class_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z_]+"), F.lit(0))


def least_weight(classes: Column, weights: dict[str, float]) -> Column:
    """Least weight over the listed classes; null if none is known."""
    return F.array_min(F.filter(F.transform(classes, lambda x: lookup(x, weights)), lambda w: w.isNotNull()))


def restricted(text: Column, words: list[str]) -> Column:
    return F.when(F.lower(text).rlike("|".join(words)), 1.0).otherwise(0.0)


def network_coefficient(classes: Column, table: dict[str, float], several: float) -> Column:
    n = F.size(classes)
    return F.when(n == 1, lookup(F.get(classes, 0), table)).when(n > 1, F.lit(several))


def walk_minutes(metres: Column) -> Column:
    return metres / 75.0


def bike_minutes(metres: Column, coef: Column) -> Column:
    return F.when(coef.isNull() | (coef == 0), 0.0).otherwise(metres * coef / 240.0)


def given_or_speed(given: Column, metres: Column, metres_per_minute: float, blocked: Column | None = None) -> Column:
    """A given time if it is positive, else by speed; blocked ways get a prohibitive one."""
    t = F.when(given > 0, given).otherwise(metres / metres_per_minute)
    return t if blocked is None else F.when(blocked, F.lit(999999.0)).otherwise(t)


def quartile_class(x: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(x >= q3, "I").when(x >= q2, "II").when(x >= q1, "III").otherwise("IV")


def count_override(cls: Column, count: Column) -> Column:
    return F.when((cls == "IV") & (count > 2000), "III").when((cls == "II") & (count > 0) & (count < 500), "III").otherwise(cls)


def break_class(x: Column, breaks: Column) -> Column:
    """1 and the number of breaks strictly below."""
    return F.size(F.filter(breaks, lambda b: b < x)) + 1


def urban_score(bd: Column, rd: Column, green: Column, mix: Column, bd95: Column, rd95: Column) -> Column:
    scaled = lambda v, p: 100 * F.least(F.lit(1.0), v / F.greatest(p, F.lit(1e-9)))
    return 0.50 * scaled(bd, bd95) + 0.25 * scaled(rd, rd95) + 0.15 * 100 * (1 - green) + 0.10 * 100 * mix


def urban_label(score: Column, bd: Column, water: Column) -> Column:
    """0 urban, 1 wild, 2 water; between 27 and 31 the building density decides."""
    return F.when(water > 0.5, 2).when(score >= 31, 0).when(score < 27, 1).when(bd >= 0.025, 0).otherwise(1)


def axis_state(x: Column, y: Column) -> Column:
    return F.when((F.abs(x) <= 720) & (F.abs(y) <= 180), "geographic").when(F.abs(x) >= 1e7, "zoned").otherwise("dezoned")


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / (perimeter * perimeter + 1e-9)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def majority(a: Column, b: Column) -> Column:
    """Of two binary ratings; a tie goes to 0."""
    return F.when(a == b, a).otherwise(0)


def size_class(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n <= 100, "small").when(n <= 200, "medium").otherwise("large")


def gaussian(d: Column, bw: Column) -> Column:
    return F.exp(-0.5 * F.pow(d / bw, 2))


def bisquare(d: Column, bw: Column) -> Column:
    return F.when(d < bw, F.pow(1 - F.pow(d / bw, 2), 2)).otherwise(0.0)


def inverse_distance(d: Column) -> Column:
    return 1 / (d + 1e-9)


def decay(t: Column, t_max: Column, beta: float = 0.15) -> Column:
    return F.when(t <= t_max, F.exp(-beta * F.pow(t / t_max, 2))).otherwise(0.0)


def water_index(green: Column, swir: Column) -> Column:
    total = green + swir
    return (green - swir) / F.when(total == 0, 1e-9).otherwise(total)


def seats(count: Column, pressure: Column, relaxed: bool = False) -> Column:
    """Capacity backed out of a count and its pressure, between 200 and 3.5 times the count, in blocks of 50."""
    raw = F.when(pressure >= 1, count).when(pressure > 0, count / F.when(pressure > 0, pressure).otherwise(1.0)).otherwise(count)
    raw = F.least(F.greatest(raw, F.lit(200.0)), F.greatest(count * 3.5, F.lit(200.0)))
    return F.ceil((raw * 1.1 if relaxed else raw) / 50) * 50


def hash_uniform(i: Column, r: Column) -> Column:
    """A number in [0, 1) from two integers, the same in any engine with 64-bit integers."""
    mixed = F.pmod(i.cast("long") * 1103515245 + r.cast("long") * 12345 + 42, F.lit(1000003))
    return F.pmod(mixed * mixed + mixed * 7919 + r.cast("long") * 104729, F.lit(999983)) / F.lit(999983.0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(v: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(v, start + 1, n), F.lit(0), lambda a, x: a + x)


def running_sums(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... of an array of ints: one more than it has.

    Sums of blocks of 64 and of 64 blocks are carried on, so the work grows with the array's length, not with its square."""
    low = lambda k: k.bitwiseAND(F.lit(63))
    every = lambda v: F.sequence(F.lit(0), F.size(v))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v), 6)), lambda k: _sum(v, k * 64, F.lit(64)))
    onto = lambda v, before: F.transform(every(v), lambda i: F.get(before, F.shiftright(i, 6)) + _sum(v, i - low(i), low(i)))
    top = lambda v: F.transform(every(v), lambda i: _sum(v, F.lit(0), i))
    return bound(values, lambda v: bound(blocks(v), lambda s1: bound(blocks(s1), lambda s2: bound(top(s2), lambda o2: bound(onto(s1, o2), lambda o1: onto(v, o1))))))


def canonical_label(c: Column, known: list[str], alias: dict[str, str]) -> Column:
    """A known label as it is, else its alias, else that of the first alias of which one is inside the other, else null."""
    s = F.trim(c)
    inside = lambda a: (s != "") & (F.contains(F.lit(a), s) | F.contains(s, F.lit(a)))
    near = F.lit(None).cast("string")
    for a, v in reversed(alias.items()):
        near = F.when(inside(a), F.lit(v)).otherwise(near)
    return F.when(s.isin(known), s).otherwise(F.coalesce(lookup(s, alias), near))


def smeared(pred: Column, factor: Column, eps: float = 1e-6) -> Column:
    """A prediction of the log target on the raw scale; factor: mean of exp(residual)."""
    return F.greatest(F.exp(pred) * factor - eps, F.lit(0.0))
