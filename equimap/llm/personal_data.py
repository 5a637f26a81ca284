"""Personal data by weak supervision, in DataFrame operations only.

Base patterns give spans that always stay; wider patterns, and base matches that fail their test, give candidates. Four
labelers vote on each of them (1 yes, -1 no, 0 abstains): the kind's strict form, a gazetteer (domain endings, reserved
addresses, issuer digits, country codes), words before the span, and the characters around it. Counts of vote patterns
are a table of bounded size, from which expectation-maximisation estimates each labeler's reliability for each kind;
its posteriors train the final span classifier (naive Bayes on the span's form, its test's outcome and the words before
it, with the kind's prior). Candidates that it finds likely are added, whatever pattern they come from. Of a card pattern's failed matches
those of a card's length, 16 to 19 digits, are candidates.

The patterns are written with possessive quantifiers and a look at the character before, so that each text is read in
linear time; the matches are those of the plain patterns. Places come from running sums by blocks, and whether a wide
match touches a base span from a search among the sorted spans, so that work stays in proportion to the matches.

Cases: a null or empty text has no spans. Null ids and repeated rows each give their row. A text of any length is read
whole. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bound, running_sums
from .common import Scratch, narrow, table

KINDS = ["email", "ip", "card", "phone"]
#: Plain forms of these are in the README.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++ ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9 -])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A text without a match of this has none of the kind's patterns.
NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{3}|[0-9][ -][0-9]", "phone": r"\+[0-9]|[0-9]{3}[.)-]"}
ENDINGS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "info"]
COUNTRY_CODES = ["+1", "+33", "+34", "+39", "+44", "+49", "+52", "+81", "+86", "+91"]
CUES = {"email": "mail|contact|kontakt|correo|courriel|write", "ip": "ip|host|server|address|adresse", "card": "card|visa|pay|karte|tarjeta|carte", "phone": "phone|call|tel|fax|mobil|kontakt|contact"}
AGAINST = "version|isbn|order|serial|invoice|sha|token|hash|part"
CONTEXT = 24
THRESHOLD = 0.9
ROUNDS = 30
#: The test's outcome for a match that failed it. A failed test speaks against a span like so many examples, until there are
#: more: a kind with a handful of failed matches can't learn what they are worth.
FAILED, AGAINST_FAILED = 1, 5.0
FEATURES = ["f_len", "f_digits", "f_left", "f_right", "f_test", "f_words"]
VOTES = ["v_form", "v_list", "v_words", "v_edge"]
_FOUND = "array<struct<s:int,e:int,m:string,l:string,r:string>>"


def _located(text: Column, pattern: str) -> Column:
    """Start, end (code points), text and surroundings of all matches of a pattern."""

    def placed(x: Column) -> Column:
        matches, pieces = x["m"], x["p"]
        every = F.sequence(F.lit(0), F.size(matches) - 1)
        sizes = F.transform(every, lambda i: F.length(F.get(pieces, i)) + F.length(F.get(matches, i)))

        def one(i: Column, before: Column) -> Column:
            m, left = F.get(matches, i), F.get(pieces, i)
            e = F.get(before, i + 1)
            return F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"), F.right(left, F.lit(CONTEXT)).alias("l"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("r"))

        return bound(running_sums(sizes), lambda before: F.transform(every, lambda i: one(i, before)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr(f"cast(array() as {_FOUND})")
    whole = lambda m: bound(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), placed)
    return bound(found, lambda m: F.when(F.size(m) > 0, whole(m)).otherwise(empty))


def _touches(c: Column, spans: Column) -> Column:
    """Whether one of the spans (sorted, apart from each other) overlaps c: of those that begin before its end, the last."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = (acc["lo"] < acc["hi"]) & (F.get(spans, mid)["s"] < c["e"])
        return F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(F.when(acc["lo"] < acc["hi"], mid).otherwise(acc["hi"])).alias("hi"))

    n = F.size(spans)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    n_before = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), start, step, lambda a: a["lo"])
    return (n > 0) & bound(n_before, lambda k: (k > 0) & (F.get(spans, F.greatest(k - 1, F.lit(0)))["e"] > c["s"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum holds; for 2 digits or more."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _by_list(kind: str, m: Column) -> Column:
    if kind == "email":
        known = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(ENDINGS)
    elif kind == "ip":
        first = F.regexp_extract(m, r"^([0-9]+)", 1).try_cast("double")
        known = F.coalesce(first.between(1, 223) & ~first.isin(10.0, 127.0), F.lit(True))
    elif kind == "card":
        known = F.substring(_digits(m), F.lit(1), F.lit(1)).isin("3", "4", "5", "6")
    else:
        known = F.array_contains(F.transform(F.array(*[F.lit(c) for c in COUNTRY_CODES]), lambda c: m.startswith(c)), True) | ~m.startswith("+")
    return F.when(known, 1).otherwise(-1)


def _candidates(kind: str, found: Column, base: bool) -> Column:
    """Candidates with votes and form features."""
    no = KINDS.index(kind)

    def one(x: Column) -> Column:
        m, left, right = x["m"], x["l"], x["r"]
        valid = _valid(kind, m) if base else F.lit(False)
        words = F.lower(left)
        edge = (left == "") | left.rlike(r"[\s(\[<:;,=|\"']$")
        ends = (right == "") | right.rlike(r"^[\s)\]>:;,.!?|\"']")
        n, digits = F.length(m), F.length(_digits(m))
        cue = F.when(words.rlike(r"\b(?:" + AGAINST + r")\b"), -1).when(words.rlike(CUES[kind]), 1).otherwise(0)
        return F.struct(
            F.lit(no).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), valid.alias("base"),
            (F.when(valid, 1).otherwise(-1) if base else F.lit(0)).alias("v_form"),
            _by_list(kind, m).alias("v_list"),
            cue.alias("v_words"),
            F.when(edge & ends, 1).otherwise(-1).alias("v_edge"),
            F.least(F.floor(n / 4), F.lit(7)).cast("int").alias("f_len"),
            F.least(F.floor(digits / 3), F.lit(7)).cast("int").alias("f_digits"),
            F.when(left == "", 0).when(left.rlike(r"\s$"), 1).when(left.rlike(r"[0-9A-Za-z]$"), 2).otherwise(3).alias("f_left"),
            F.when(right == "", 0).when(right.rlike(r"^\s"), 1).when(right.rlike(r"^[0-9A-Za-z]"), 2).otherwise(3).alias("f_right"),
            (F.when(valid, 2).otherwise(FAILED) if base else F.lit(0)).alias("f_test"),
            (cue + 1).alias("f_words"),
        )

    if kind == "card" and base:  # most digit runs are far from a card; only those of its length are candidates
        found = F.filter(found, lambda x: (F.length(x["m"]) >= 16) & F.length(_digits(x["m"])).between(16, 19))
    return F.transform(found, one)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `cands`: all candidates by kind and start. Wide matches that touch a valid base span are left out."""
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    none = F.expr(f"cast(array() as {_FOUND})")
    for kind in KINDS:
        any_ = F.col("_t").rlike(NEEDS[kind])
        rows = rows.withColumns({f"_{name}_{kind}": F.when(any_, _located(F.col("_t"), pattern)).otherwise(none) for name, pattern in (("b", BASE[kind]), ("w", WIDE[kind]))})
    for kind in KINDS:
        rows = rows.withColumns({f"_cb_{kind}": _candidates(kind, F.col(f"_b_{kind}"), True), f"_cw_{kind}": _candidates(kind, F.col(f"_w_{kind}"), False)})
    rows = rows.withColumns({f"_valid_{kind}": F.filter(f"_cb_{kind}", lambda c: c["base"]) for kind in KINDS})

    def free(w: Column) -> Column:
        touched = lambda c: F.forall(F.array(*[~_touches(c, F.col(f"_valid_{kind}")) for kind in KINDS]), lambda x: x)
        return F.when(F.size(w) > 0, F.filter(w, touched)).otherwise(w)

    parts = [x for kind in KINDS for x in (F.col(f"_cb_{kind}"), free(F.col(f"_cw_{kind}")))]
    return rows.select(*docs.columns, F.array_sort(F.concat(*parts)).alias("cands"))


def reliabilities(cells: list[dict], rounds: int = ROUNDS) -> tuple[list[float], dict]:
    """Expectation-maximisation over counted vote patterns: the posterior of each cell, and for each kind the prior and
    each labeler's rate of each vote given yes and given no."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(c[v] for v in VOTES))) for c in cells]
    rates: dict = {}
    for _ in range(rounds):
        rates = {}
        for k in range(len(KINDS)):
            own = [(c, p) for c, p in zip(cells, post, strict=True) if c["kind"] == k]
            yes = 1.0 + sum(c["n"] * p for c, p in own)
            no = 1.0 + sum(c["n"] * (1 - p) for c, p in own)
            rates[k, "prior"] = yes / (yes + no)
            for v in VOTES:
                for x in (-1, 0, 1):
                    # a labeler is taken to be better than chance until its votes say otherwise
                    a = 1.0 + x + sum(c["n"] * p for c, p in own if c[v] == x)
                    b = 1.0 - x + sum(c["n"] * (1 - p) for c, p in own if c[v] == x)
                    rates[k, v, x] = ((a + 0.1) / (yes + 2.3), (b + 0.1) / (no + 2.3))
        for i, c in enumerate(cells):
            q = rates[c["kind"], "prior"]
            odds = math.log(q / (1 - q))
            for v in VOTES:
                if c[v]:
                    a, b = rates[c["kind"], v, c[v]]
                    odds += math.log(a / b)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def train(cands: DataFrame) -> dict:
    """Weights of the final classifier: (kind, feature, value) -> log odds, and (kind, 'prior')."""
    counted = cands.select(F.explode("cands").alias("c")).groupBy(*[F.col(f"c.{x}").alias(x) for x in ("kind", *VOTES, *FEATURES)]).agg(F.count(F.lit(1)).alias("n"))
    cells = [r.asDict() for r in counted.collect()]  # at most kinds * 3^votes * values^features cells, whatever the input
    cells.sort(key=lambda c: tuple(c.values()))
    post, _ = reliabilities(cells)
    weights: dict = {}
    for k in range(len(KINDS)):
        own = [(c, p) for c, p in zip(cells, post, strict=True) if c["kind"] == k]
        yes, no = 1.0 + sum(c["n"] * p for c, p in own), 1.0 + sum(c["n"] * (1 - p) for c, p in own)
        weights[k, "prior"] = math.log(yes / no)
        for f in FEATURES:
            for x in range(8):
                a = 0.5 + sum(c["n"] * p for c, p in own if c[f] == x)
                b = 0.5 + sum(c["n"] * (1 - p) for c, p in own if c[f] == x)
                if (f, x) == ("f_test", FAILED):
                    b += AGAINST_FAILED
                weights[k, f, x] = math.log(a / (yes + 4)) - math.log(b / (no + 4))
    return weights


def score(c: Column, weights: dict) -> Column:
    """The classifier's probability for a candidate."""
    flat = lambda values: F.expr("array(" + ",".join(f"{v:.12e}D" for v in values) + ")")
    odds = F.get(flat(weights[k, "prior"] for k in range(len(KINDS))), c["kind"])
    for f in FEATURES:
        odds = odds + F.get(flat(weights[k, f, x] for k in range(len(KINDS)) for x in range(8)), c["kind"] * 8 + c[f])
    return 1 / (1 + F.exp(-odds))


def personal_data(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, spans (array of kind, s, e, base), by kind and start."""
    cands = scratch.put(candidates(narrow(docs, id_col, text), text).drop(text))
    weights = train(cands)
    kept = F.filter("cands", lambda c: c["base"] | (score(c, weights) > threshold))
    return cands.select(id_col, F.transform(kept, lambda c: F.struct(c["kind"], c["s"], c["e"], c["base"])).alias("spans"))


def _text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("long")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    base = F.filter("spans", lambda c: c["base"])
    n = [counted(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
