"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary with scores is compiled to a deterministic transducer over characters. A token sequence is the
encoding of its text exactly where each pair of neighbours is the encoding of their joined text, so the last token of each
prefix follows from the last tokens a few characters before. A state holds what the next characters can depend on: the
pieces that are open (nodes of the trie of pieces), the token before each and how many tokens earlier it ends. A transition
reads a character and is annotated with the number of tokens that it adds to the encoding of the prefix (it may be negative,
where tokens close to one). Between two characters that no piece holds side by side all states fall together.

States are compiled when a text first needs them and kept in the worker, at most MOST_STATES of them between runs.

Texts are cut into chunks, which are read in lockstep, a character of each at a time. Most chunks begin where all states fall
together. The others are state maps: their results from each of a few states that the characters before them lead to. The
maps are composed by a parallel prefix scan, which tells each chunk's real state; one outside a map is added to it and the
scan repeated, so counts are exact whatever the text. A text of millions of characters is as many chunks.

Cases: null counts as empty; an empty text has no tokens. Repeated rows give a row each. Other columns aren't read. An empty
table gives an empty result. Models of another kind than byte-pair pieces with byte fallback, or with a normalisation beyond
the escaping of spaces, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, runs, table, tidied

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk, and those before a cut that are looked through for a place where all states fall together.
CHUNK = 256
WARM = 48
#: Bytes of a run of documents that are read in lockstep.
RUN = 1 << 20
MOST_STATES = 400_000
SPACE = "▁"
NONE = -1


class Vocabulary:
    """Pieces and their scores, as read from a model's file on the driver; at most tens of thousands."""

    def __init__(self, pieces: dict[str, float]) -> None:
        lone = {c for p in pieces for c in p if c not in pieces}
        if lone or SPACE not in pieces:
            raise ValueError(f"characters that are no pieces: {sorted(lone or {SPACE})[:5]}")
        self.pieces = pieces
        self.name = hashlib.sha256(repr(sorted(pieces.items())).encode()).hexdigest()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        plain = norm.add_dummy_prefix and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix)
        kinds = {p.type for p in spec.pieces}
        if train.model_type != train.BPE or not train.byte_fallback or not plain or not norm.escape_whitespaces or sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED in kinds:
            raise ValueError(f"{path}: not a byte-pair model with byte fallback and plain normalisation")
        m = SentencePieceProcessor(model_file=path)
        special = lambda i: m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i)
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not special(i)})


class Transducer:
    """The states and transitions that texts have needed so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.scores = vocabulary.pieces
        letters = sorted({c for p in self.scores for c in p})
        self.letters = letters
        n = len(letters)
        self.classes = n + 4  # after the letters: characters of 1 to 4 bytes that are no pieces
        self.class_of = np.full(0x110000, n, np.int32)
        self.class_of[0x80:] = n + 1
        self.class_of[0x800:] = n + 2
        self.class_of[0x10000:] = n + 3
        self.class_of[[ord(c) for c in letters]] = np.arange(n)
        self.class_of[ord(" ")] = self.class_of[ord(SPACE)]
        # the trie of the pieces: children by (node, letter), and the piece that ends at a node
        self.child: dict[tuple[int, str], int] = {}
        self.piece: list[str | None] = [None]
        self.open = [True]
        for p in self.scores:
            at = 0
            for c in p:
                to = self.child.get((at, c))
                if to is None:
                    to = self.child[at, c] = len(self.piece)
                    self.piece.append(None)
                    self.open.append(False)
                    self.open[at] = True
                at = to
            self.piece[at] = p
        self.longest = max(map(len, self.scores))
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        # bits at hashed places of letter pairs: one that is unset tells that no piece holds the pair
        self.pair_bits = np.zeros(1 << 22, bool)
        a, b = (np.array([self.class_of[ord(p[i])] for p in self.pairs], np.int64) for i in (0, 1))
        self.pair_bits[self._pair_place(a, b)] = True
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.state_list: list[tuple] = []
        self.fits: dict[tuple[str, str], bool] = {}
        self.start = self._number((None, ()))
        self._table(16)
        self.begun, self.begun_count = self._one(self.start, self.class_of[ord(SPACE)])

    @staticmethod
    def _pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40503 + b) & ((1 << 22) - 1)

    def apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether no token can hold these two classes side by side."""
        return ~self.pair_bits[self._pair_place(before.astype(np.int64), after.astype(np.int64))]

    def encoded(self, text: str) -> list[str]:
        """Byte-pair merges of a short text of letters: best score first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, before: str | None, token: str) -> bool:
        """Whether token can follow before (None: nothing that matters)."""
        if before and before[-1] + token[0] not in self.pairs:
            before = None
        key = (before or "", token)
        found = self.fits.get(key)
        if found is None:
            want = [before, token] if before else [token]
            found = self.fits[key] = self.encoded("".join(want)) == want
        return found

    def _number(self, state: tuple) -> int:
        found = self.states.get(state)
        if found is None:
            found = self.states[state] = len(self.state_list)
            self.state_list.append(state)
        return found

    def transition(self, state: int, cls: int) -> tuple[int, int]:
        """The next state, and by how many tokens the encoding grows."""
        if cls >= len(self.letters):
            return self.start, cls - len(self.letters) + 1  # bytes
        c = self.letters[cls]
        last, opened = self.state_list[state]
        if last is not None and last[-1] + c not in self.pairs:
            last, opened = None, ()
        token, grown, now = None, 0, []
        for node, before, ahead in (*opened, (0, last, 0)):
            to = self.child.get((node, c))
            if to is None:
                continue
            piece = self.piece[to]
            if token is None and piece is not None and self.fit(before, piece):
                token, grown = piece, ahead + 1
            if self.open[to]:
                first = c if node == 0 else None
                now.append((to, None if first and before and before[-1] + first not in self.pairs else before, ahead))
        assert token is not None, (self.state_list[state], c)
        return self._number((token, tuple((node, before, ahead - grown) for node, before, ahead in now))), grown

    # --- transitions in an array, by open addressing: (state, class), and the next state with the added tokens

    def _table(self, bits: int) -> None:
        self.shift, self.mask, self.filled = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.slots = np.full((1 << bits, 2), NONE, np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _put(self, rows: np.ndarray) -> None:
        self.filled += len(rows)
        at = self._place(rows[:, 0])
        while len(rows):
            one = np.zeros(len(rows), bool)
            one[np.unique(at, return_index=True)[1]] = True
            one &= self.slots[at, 0] == NONE
            self.slots[at[one]] = rows[one]
            rows, at = rows[~one], (at[~one] + 1) & self.mask

    def _compile(self, keys: np.ndarray) -> None:
        found = [self.transition(*divmod(k, self.classes)) for k in keys.tolist()]
        if 4 * (self.filled + len(keys)) > self.mask:
            old = self.slots[self.slots[:, 0] != NONE]
            self._table(max(16, (8 * (self.filled + len(keys))).bit_length()))
            self._put(old)
        to, grown = np.array(found, np.int64).T
        self._put(np.stack((keys, (to << 8) + (grown + 128)), axis=1))

    def _one(self, state: int, cls: int) -> tuple[int, int]:
        to, grown = self.step(np.array([state]), np.array([cls]))
        return int(to[0]), int(grown[0])

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state * np.int64(self.classes) + cls
        at = self._place(key)
        slot = self.slots.take(at, axis=0)
        off, absent = np.flatnonzero(slot[:, 0] != key), []
        while len(off):
            empty = slot[off, 0] == NONE
            if empty.any():
                absent.append(key[off[empty]])
                off = off[~empty]
            at[off] = (at[off] + 1) & self.mask
            slot[off] = self.slots.take(at[off], axis=0)
            off = off[slot[off, 0] != key[off]]
        if absent:
            self._compile(np.unique(np.concatenate(absent)))
            return self.step(state, cls)
        return slot[:, 1] >> 8, (slot[:, 1] & 255) - 128

    def read(self, cls: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads all stretches in lockstep: their last states, and the tokens that they add."""
        order = np.argsort(-size, kind="stable")
        begin, size, state, count = begin[order], size[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        ends = -size
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(ends, -k))  # those longer than k come first
            to, grown = self.step(state[:live], cls[begin[:live] + k])
            state[:live] = to
            count[:live] += grown
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def counts(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> np.ndarray:
        """Tokens of each document of a run: its UTF-8 bytes on end, and len(documents) + 1 byte positions. chunk is at least
        warm and the longest piece together."""
        if len(self.state_list) > MOST_STATES:
            self.forget()
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        cls = self.class_of[points]
        ahead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        first, last = ahead[offsets[:-1]], ahead[offsets[1:]]
        docs = np.flatnonzero(last > first)
        out = np.zeros(len(first), np.int64)
        if not len(docs):
            return out
        # chunks: doc, begin, end, and how they begin
        cuts = (last[docs] - first[docs] - 1) // chunk
        doc = np.repeat(docs, cuts + 1)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts + 1) - (cuts + 1), cuts + 1)
        begin = first[doc] + nth * chunk
        inner = nth > 0
        loose = np.zeros(len(doc), bool)
        if inner.any():
            place = begin[inner][:, None] - np.arange(warm)[None, :]
            free = self.apart(cls[place - 1], cls[place])
            begin[inner] -= np.where(free.any(axis=1), free.argmax(axis=1), 0)
            loose[inner] = ~free.any(axis=1)
        end = np.append(begin[1:], 0)
        lasts = np.append(doc[1:] != doc[:-1], True)
        end[lasts] = last[doc[lasts]]
        tight = np.flatnonzero(~loose)
        state = np.where(nth == 0, self.begun, self.start)
        last_state, grown = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        last_state[tight], grown[tight] = self.read(cls, begin[tight], end[tight] - begin[tight], state[tight])
        if loose.any():
            grown[loose] = self.composed(cls, begin, end, np.flatnonzero(loose), last_state, warm)
        np.add.at(out, doc, grown)
        out[docs] += self.begun_count
        return out

    def composed(self, cls: np.ndarray, begin: np.ndarray, end: np.ndarray, loose: np.ndarray, last_state: np.ndarray, warm: int) -> np.ndarray:
        """Tokens that the loose chunks add, by composing their state maps; last_state: the other chunks' last states."""
        m, w = len(loose), self.longest
        back = warm + np.arange(w)
        domain = self.read(cls, (begin[loose][:, None] - back).ravel(), np.tile(back, m), np.full(m * w, self.start))[0].reshape(m, w)
        size = end[loose] - begin[loose]
        # equal states of a chunk are read once
        key, inverse = np.unique(np.stack((np.repeat(np.arange(m), w), domain.ravel())), axis=1, return_inverse=True)
        to, add = self.read(cls, begin[loose][key[0]], size[key[0]], key[1])
        to, add = to[inverse.ravel()].reshape(m, w), add[inverse.ravel()].reshape(m, w)
        follows = np.append(False, loose[1:] == loose[:-1] + 1)
        while True:
            w = domain.shape[1]
            before = np.where(follows[:, None], np.vstack((to[:1], to[:-1])), last_state[loose - 1][:, None])
            # the place in a chunk's domain for each place in that of the chunk before; w: in none
            move = np.full((m, w + 1), w)
            for j in range(w - 1, -1, -1):
                move[:, :w][before == domain[:, j : j + 1]] = j
            move[~follows, w] = move[~follows, 0]
            reach = 1
            while reach < m:
                move[reach:] = np.take_along_axis(move[reach:], move[:-reach].copy(), axis=1)
                reach *= 2
            at = move[:, 0]
            missed = np.flatnonzero((at == w) & ~(follows & (np.append(0, at[:-1]) == w)))
            if not len(missed):
                return add[np.arange(m), at]
            was = np.where(follows[missed], to[missed - 1, np.minimum(at[missed - 1], w - 1)], last_state[loose[missed] - 1])
            domain, to, add = (np.hstack((x, np.full((m, 1), NONE))) for x in (domain, to, add))
            domain[missed, w] = was
            to[missed, w], add[missed, w] = self.read(cls, begin[loose[missed]], size[missed], was)


#: A worker's transducer by its vocabulary's name: it is used again by later batches and tasks.
_COMPILED: dict[str, Transducer] = {}


def token_counts(spark: SparkSession, text: Column, path: str) -> Column:
    """How many tokens the model at path gives a text column (long; null: 0), without begin, end or added tokens. Only the
    pieces, read on the driver, are sent to the workers."""
    vocabulary = Vocabulary.read(path)
    shared, mine = spark.sparkContext.broadcast(vocabulary), vocabulary.name

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def scan(batches):
            for texts in batches:
                if mine not in _COMPILED:
                    _COMPILED.clear()
                    _COMPILED[mine] = Transducer(shared.value)
                found = [_COMPILED[mine].counts(data, offsets) for _, data, offsets in runs(texts, RUN)]
                yield pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

        yield from tidied(scan)(batches)

    return counted(text)


def counted_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs' other columns, n_bytes, n_tokens, over_limit."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(c) for c in docs.columns if c != text]
    out = docs.select(*rest, F.octet_length(whole).cast("long").alias("n_bytes"), token_counts(docs.sparkSession, whole, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted_tokens(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path(MODEL))
