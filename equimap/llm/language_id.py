"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into segments; two gated recurrent layers read each segment in both directions and label every
position, and the label probabilities of all positions of a text are averaged. Training is backpropagation through time
with Adam on segments of a bounded sample: PER_LANGUAGE documents of each language at most, SEGMENTS segments of each,
at hashed places. All documents are read whole when they are judged.

Cases: a null text or one without a letter is `und` with score 0. A null language isn't learned. Null ids are held out of
training. Without any document to learn from everything is `und`. Repeated rows each give their row; an empty table
gives an empty result. More than MOST_LANGUAGES languages to learn raise an error, since none may be left out. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, runs, table, tidied

HIDDEN = 8
SEGMENT = 96
PER_LANGUAGE = 500
SEGMENTS = 4
MOST_LANGUAGES = 200
EPOCHS = 6
UNKNOWN = "und"
#: Segments that go through the network at once.
PART = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights: for each direction wx (256 x 3H, a byte's input to reset, update and candidate), u (H x 2H), uc (H x H);
    v (2H x languages), b."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"wx{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
            self.p[f"uc{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        self.p["b"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, H) for bytes x (time, batch) in direction d."""
        h, wx, u, uc = self.h, self.p[f"wx{d}"], self.p[f"u{d}"], self.p[f"uc{d}"]
        out = np.empty((*x.shape, h), np.float32)
        s = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = wx[x[t]]
            g = s @ u
            g += a[:, : 2 * h]
            _sigmoid(g)
            r, z = g[:, :h], g[:, h:]
            c = (r * s) @ uc
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            new = c - s
            new *= z
            new += s
            if keep is not None:
                keep.append((t, s, r, z, c))
            out[t] = s = new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, languages) for bytes x (time, batch)."""
        h = self.h
        y = self._forward(x, "f") @ self.p["v"][:h]
        y += self._forward(x, "b") @ self.p["v"][h:]
        y += self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        h, p = self.h, self.p
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._forward(x, d, kept[d]) for d in "fb"], axis=2)
        y = states @ p["v"] + p["b"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        y[:, np.arange(x.shape[1]), label] -= 1
        y *= (mask / mask.sum())[:, :, None]
        flat = y.reshape(-1, y.shape[2])
        g = {"v": states.reshape(-1, 2 * h).T @ flat, "b": flat.sum(0)}
        for k, d in enumerate("fb"):
            down = y @ p["v"][k * h : (k + 1) * h].T
            wx, u, uc = (np.zeros_like(p[f"{n}{d}"]) for n in ("wx", "u", "uc"))
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, s, r, z, c in reversed(kept[d]):
                ds = down[t] + carry
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s) * z * (1 - z)
                drs = dc @ p[f"uc{d}"].T
                dr = drs * s * r * (1 - r)
                dg = np.concatenate((dr, dz), axis=1)
                carry = ds * (1 - z) + drs * r + dg @ p[f"u{d}"].T
                uc += (r * s).T @ dc
                u += s.T @ dg
                np.add.at(wx, x[t], np.concatenate((dg, dc), axis=1))
            g |= {f"wx{d}": wx, f"u{d}": u, f"uc{d}": uc}
        return g

    def train(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                step += 1
                lr = rate * (0.5 if epoch >= epochs // 2 else 1.0)
                for k, g in self.gradients(x[at].T, mask[at].T, label[at]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a run of documents as rows of `length`: bytes, count of real bytes, document."""
    size = np.diff(offsets)
    per = -(-size // length)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][doc] + nth * length
    real = np.minimum(length, offsets[1:][doc] - start)
    at = start[:, None] + np.arange(length)
    x = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros((0, length), np.uint8)
    x[np.arange(length) >= real[:, None]] = 0
    return x, real, doc


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, hidden: int = HIDDEN, length: int = SEGMENT, epochs: int = EPOCHS) -> Network | None:
    """Learns from the rows of docs that aren't held out."""
    rows = docs.filter(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col(lang) == k, min(1.0, 1.3 * per_language / n)).otherwise(share)
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    picked = rows.filter(at < share * (1 << 30))
    # windows of code points at hashed places, of which the first `length` bytes are used
    n = F.length(text)
    places = F.array(*[F.pmod(F.xxhash64(F.col(id_col), F.lit(j)), F.greatest(F.lit(1), n - length)).cast("int") for j in range(SEGMENTS)])
    texts = F.transform(F.array_distinct(places), lambda p: F.substring(F.col(text), p + 1, F.lit(length)))
    sample = picked.select(F.col(lang).alias("lang"), texts.alias("t"), at.alias("at"), F.col(id_col).alias("i")).orderBy("at", "i", "lang").limit(2 * per_language * len(sizes)).collect()
    languages = sorted(sizes)
    seen: dict[str, int] = {}
    x, mask, label = [], [], []
    for r in sample:
        if seen.setdefault(r["lang"], 0) >= per_language:
            continue
        seen[r["lang"]] += 1
        for t in r["t"]:
            raw = t.encode()[:length]
            x.append(np.frombuffer(raw.ljust(length, b"\0"), np.uint8))
            mask.append(np.arange(length) < len(raw))
            label.append(languages.index(r["lang"]))
    if not x:
        return None
    net = Network(languages, hidden)
    net.train(np.stack(x), np.stack(mask).astype(np.float32), np.array(label), epochs)
    return net


def predicted(spark: SparkSession, net: Network | None, text: Column, length: int = SEGMENT) -> Column:
    """struct(lang_pred, score) of a text column. Only the text goes to the Python workers, and only these two fields come
    back: the other columns of the rows stay where they are."""
    if net is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def scan(batches):
            net = shared.value
            for letters, texts in batches:
                n = len(letters)
                letters = letters.to_numpy(zero_copy_only=False)
                total = np.zeros((n, len(net.languages)))
                for i, data, offsets in runs(texts, 1 << 19):
                    x, real, doc = segments(data, offsets, length)
                    for a in range(0, len(x), PART):  # a very long document is read in parts
                        p = net.probabilities(np.ascontiguousarray(x[a : a + PART].T))
                        p[np.arange(length)[:, None] >= real[a : a + PART]] = 0
                        np.add.at(total, i + doc[a : a + PART], p.sum(axis=0, dtype=np.float64))
                count = total.sum(axis=1)
                best = total.argmax(axis=1)
                ok = letters & (count > 0)
                score = np.where(ok, total[np.arange(n), best] / np.maximum(count, 1e-9), 0.0).round(6)
                pred = [net.languages[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], names=["lang_pred", "score"])

        yield from tidied(scan)(batches)

    return judged(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), text)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = predicted(spark, fit(docs), F.col("text"))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))
