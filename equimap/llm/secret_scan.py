"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 characters or more of those that keys are made of. Its features: length, character classes and
how often neighbouring characters change class, character entropy, how plausible its character pairs are beside those of
the corpus's words (transitions), the share that the corpus's frequent words cover (dictionary), whether it looks like a
path or address, and key words and key signs before and behind it. The forest (bootstrap samples, random features at each
split, Gini) is trained in numpy from labelled findings; a finding is kept if its mean vote reaches a threshold.

Dictionary and transitions come from a count of all words of all documents; the driver gets the DICTIONARY_WORDS most
frequent words and at most 26 x 26 counts of letter pairs. Labelled findings are a table (text, start, end, label), of which
at most MOST_FINDINGS rows, by hash, are used; one in HELD_OUT of them is kept from training and tells precision and recall.
The production forest's table is made by a seeded rule from public key formats and from common false positives (long words,
paths, addresses, numbers, check sums named as such, placeholders), with the corpus's words; others can be passed instead.

Cases: a null or empty text has no candidates and a text of any length is read whole. Null ids and repeated rows each
give their findings. Without findings to learn from an error is raised. An empty table gives an empty result; a corpus
without words has an empty dictionary. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, table, tidied

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
THRESHOLD = 0.5
AROUND = 32
DICTIONARY_WORDS = 5000
MOST_FINDINGS = 50_000
HELD_OUT = 5
KEY_WORDS = ["token", "secret", "password", "passwd", "pwd", "api", "key", "auth", "credential", "bearer", "private"]
OTHER_WORDS = ["sha", "md5", "commit", "checksum", "hash", "uuid", "version", "http", "example", "integrity", "etag", "digest"]
#: Words of made findings where the corpus has none.
PLAIN = ["the", "and", "for", "that", "with", "this", "from", "have", "not", "are"]


class Words:
    """The corpus's frequent words, for coverage, and log probabilities of its letter pairs, smoothed."""

    def __init__(self, top: list[str], pairs: dict[str, int]) -> None:
        self.top = top
        n = np.full((26, 26), 0.05)
        for pair, k in pairs.items():
            n[ord(pair[0]) - 97, ord(pair[1]) - 97] += k
        self.log = np.log(n / n.sum(axis=1, keepdims=True))
        self._find = None

    @classmethod
    def of(cls, words: list[str]) -> Words:
        pairs: dict[str, int] = {}
        for w in words:
            for a, b in zip(w, w[1:]):
                pairs[a + b] = pairs.get(a + b, 0) + 1
        return cls(words, pairs)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}

    def covered(self, low: str) -> int:
        """Characters inside frequent words, the longest at each place, without overlaps."""
        if not self.top:
            return 0
        if self._find is None:
            import ahocorasick

            self._find = ahocorasick.Automaton()
            for w in self.top:
                self._find.add_word(w, len(w))
            self._find.make_automaton()
        return sum(n for _, n in self._find.iter_long(low))


def learned_words(docs: DataFrame, scratch: Scratch, text: str = "text", most: int = DICTIONARY_WORDS) -> Words:
    """From all words of three ASCII letters or more of all documents."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    counts = scratch.put(found.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    top = [r[0] for r in counts.filter("length(w) <= 24").orderBy(F.desc("n"), "w").limit(most).collect()]
    at = F.sequence(F.lit(1), F.length("w") - 1)
    pairs = counts.select("n", F.explode(F.transform(at, lambda i: F.substring("w", i, F.lit(2)))).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
    return Words(top, {r["p"]: r["n"] for r in pairs.collect()})


def features(text: str, start: int, end: int, words: Words) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    n = len(s)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in s]
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = s.lower()
    pairs = [words.log[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    return [
        float(min(n, 200)),
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("p") / n,
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        entropy,
        sum(pairs) / len(pairs) if pairs else -6.0,
        len(pairs) / n,
        words.covered(low) / n,
        float(s.count("/") + s.count(".")),
        float(bool(re.search(r"\.[a-z]{2,5}$", low)) or low.startswith("/") or "//" in low or before.endswith("/")),
        float(set(low) <= set("0123456789abcdef")),
        float(any(w in before for w in KEY_WORDS)),
        float(any(w in before or w in after for w in OTHER_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(after[:1] in ("'", '"')),
    ]


class Forest:
    """Trees as arrays: feature, bound, left, right, value."""

    def __init__(self, trees: int = 25, depth: int = 8, seed: int = 5) -> None:
        self.n, self.depth, self.seed = trees, depth, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        if not len(x):
            raise ValueError("no labelled findings")
        rng = np.random.default_rng(self.seed)
        tries = max(1, math.isqrt(x.shape[1]) + 1)
        for _ in range(self.n):
            at = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[at], y[at], 0, tries, rng, nodes)
            cols = np.array(nodes).T
            self.trees.append((cols[0].astype(int), cols[1], cols[2].astype(int), cols[3].astype(int), cols[4]))
        return self

    def _grow(self, x, y, depth, tries, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y.mean())])
        if depth >= self.depth or len(y) < 4 or y.min() == y.max():
            return me
        best = None
        for f in rng.permutation(x.shape[1])[:tries]:
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            c = np.cumsum(t)
            left, right = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(t) - cut)
            gini = cut * left * (1 - left) + (len(t) - cut) * right * (1 - right)
            k = int(np.argmin(gini))
            if best is None or gini[k] < best[0]:
                best = (float(gini[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
        if best is None:
            return me
        _, f, bound = best
        side = x[:, f] <= bound
        nodes[me][:2] = [f, bound]
        nodes[me][2] = self._grow(x[side], y[side], depth + 1, tries, rng, nodes)
        nodes[me][3] = self._grow(x[~side], y[~side], depth + 1, tries, rng, nodes)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), f] <= bound[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += value[at]
        return total / len(self.trees)


#: Kinds of made findings; each is head, body and tail. The first ones are secrets.
SECRETS = ["hex_key", "quoted_hex", "api_key", "password", "aws", "github", "quoted", "bearer", "stripe", "slack"]
#: Share of made secrets without key words around them; plain hexadecimal ones would then be like check sums.
BARE = 0.3
OTHERS = ["word", "title", "shout", "dashes", "path", "address", "commit", "sha", "number", "uuid", "filler", "snake", "rule", "double_rule", "host"]


def made_findings(words: Words, n: int = 2400, seed: int = 3, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): labelled findings by a seeded rule, in equal parts secrets and others, without some kinds
    or of some kinds only."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, every, vocabulary = "0123456789abcdef", upper + lower + digits, words.top if len(words.top) >= len(PLAIN) else PLAIN
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    one = lambda of: of[int(rng.integers(0, len(of)))]
    some = lambda k: [vocabulary[int(len(vocabulary) * u * u)] for u in rng.random(k)]  # frequent ones more often
    run = lambda: "".join(some(9))[: int(rng.integers(16, 48))].ljust(16, "e")
    makers = {
        "hex_key": lambda: (one(["secret", "password", "api_key", "auth_key", "private key"]) + one([": ", "=", " = ", ' = "', "='"]), pick(hexa, one([24, 32, 48, 56, 64])), ""),
        "quoted_hex": lambda: (one(["secret", "passwd", "api-key", "credential"]) + one([": ", "=", " = "]) + '"', pick(hexa, one([24, 32, 48, 56, 64])), '"'),
        "api_key": lambda: ("api_key: ", pick(every, 32), ""),
        "password": lambda: ("password=", pick(every + "+/", 20), ""),
        "aws": lambda: ("", "AKIA" + pick(upper + digits, 16), ""),
        "github": lambda: ("auth ", "ghp_" + pick(every, 36), ""),
        "quoted": lambda: ('secret = "', pick(every + "+/", 40), '"'),
        "bearer": lambda: ("bearer ", pick(every, 24) + "." + pick(every, 40), ""),
        "stripe": lambda: ("", "sk_live_" + pick(every, 24), ""),
        "slack": lambda: ("key ", "xoxb-" + pick(digits, 12) + "-" + pick(every, 24), ""),
        "word": lambda: ("", run(), ""),
        "title": lambda: ("", run().capitalize(), "."),
        "shout": lambda: ("", run().upper(), "!!"),
        "dashes": lambda: ("", "-".join(some(5)).ljust(16, "e"), ""),
        "path": lambda: ("", "/" + "/".join(some(4)) + "/index.html", ""),
        "address": lambda: ("http://", ".".join(some(3)) + ".example.com/" + some(1)[0], ""),
        "commit": lambda: ("commit ", pick(hexa, 40), ""),
        "sha": lambda: ("sha256:", pick(hexa, 64), ""),
        "number": lambda: ("", pick(digits, 16), ""),
        "uuid": lambda: ("uuid ", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        "filler": lambda: ("token = ", '"' + "x" * 24, '"'),
        "snake": lambda: ("", "_".join(some(4)).ljust(16, "e"), ""),
        "rule": lambda: ("", "-" * int(rng.integers(16, 60)), ""),
        "double_rule": lambda: ("", "=" * int(rng.integers(16, 60)), ""),
        "host": lambda: (one(["", "", some(1)[0] + "@"]), (some(1)[0] + pick(digits, int(rng.integers(0, 4))) + one([".", "-"]) + some(1)[0] + pick(digits, int(rng.integers(0, 2))) + one([".com", ".org", ".net", ".co.uk"])).rjust(16, "w"), ""),
    }
    kinds = [[k for k in side if k not in without and (not only or k in only)] for side in (OTHERS, SECRETS)]
    out = []
    for i in range(n):
        if not kinds[i % 2]:
            continue
        kind = kinds[i % 2][int(rng.integers(0, len(kinds[i % 2])))]
        head, body, tail = makers[kind]()
        if i % 2 and kind not in ("hex_key", "quoted_hex") and rng.random() < BARE:
            head, tail = "", ""
        text = f"{' '.join(some(4))} {head}{body}{tail} {' '.join(some(3))}"
        at = text.index(body, len(head))
        m = next((m for m in CANDIDATE.finditer(text) if m.start() < at + len(body) and m.end() > at), None)
        if m:
            out.append((text, m.start(), m.end(), i % 2))
    return out


FINDINGS = "text string, start int, end int, label int"


def bounded(findings: DataFrame, most: int = MOST_FINDINGS) -> tuple[list, list]:
    """The labelled findings (text, start, end, label) to train from and the held-out ones, `most` at most, by hash."""
    h = F.xxhash64("text", "start", "end")
    rows = findings.filter("text is not null and start is not null and end is not null and label is not null").select("text", "start", "end", "label", (F.pmod(h, F.lit(HELD_OUT)) == 0).alias("held"))
    got = rows.orderBy(h, "text", "start", "end", "label").limit(most).collect()
    return [tuple(r[:4]) for r in got if not r.held], [tuple(r[:4]) for r in got if r.held]


def train(findings: list[tuple[str, int, int, int]], words: Words) -> Forest:
    x = np.array([features(t, a, b, words) for t, a, b, _ in findings])
    return Forest().fit(x, np.array([f[3] for f in findings], float))


def judged(forest: Forest, findings: list[tuple[str, int, int, int]], words: Words, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Precision and recall on labelled findings."""
    if not findings:
        return math.nan, math.nan
    said = forest.predict(np.array([features(t, a, b, words) for t, a, b, _ in findings])) >= threshold
    true = np.array([f[3] for f in findings]) == 1
    return float((said & true).sum() / max(1, said.sum())), float((said & true).sum() / max(1, true.sum()))


def scan(docs: DataFrame, forest: Forest, words: Words, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All candidates: id, start, end (code points, end exclusive), secret_sha256, score, is_secret."""
    shared = docs.sparkSession.sparkContext.broadcast((forest, words))

    def find(batches):
        import pyarrow as pa

        forest, words = shared.value
        for batch in batches:
            rows, x = [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                for m in CANDIDATE.finditer(t):
                    rows.append((i, m.start(), m.end(), hashlib.sha256(m[0].encode()).hexdigest()))
                    x.append(features(t, m.start(), m.end(), words))
            score = forest.predict(np.array(x)).round(6) if x else np.zeros(0)
            at = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array(score), pa.array(score >= threshold)],
                names=[id_col, "start", "end", "secret_sha256", "score", "is_secret"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow(docs, id_col, text).mapInArrow(tidied(find), f"`{id_col}` {kind}, start long, end long, secret_sha256 string, score double, is_secret boolean")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = learned_words(docs, Scratch(spark, "op1"))
    findings, _ = bounded(spark.createDataFrame(made_findings(words), FINDINGS))
    return scan(docs, train(findings, words), words)
