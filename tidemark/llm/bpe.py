"""BPE encoding by dynamic programming over prefixes, and decoding.

The BPE encoding of every prefix of a word is unique, so each prefix has one last token.
For each end position an automaton over the vocabulary lists the tokens that end there;
the right one is the only token whose start is position 0, or is compatible with the
stored last token of the prefix before it.  Two tokens are compatible if BPE of their
joined bytes gives back exactly the two.  Back-pointers from the end give the ids.

The automaton reads all new words of a batch as one string, and the recurrence runs over
all of them at once, one end position after another.  Words repeat, so a bounded cache
keeps the ids of recent chunks; it changes no result.

Defined edge results: null and empty texts give no ids and decode to an empty text; very
long texts and words are covered whole; repeated rows are encoded alike; strings of added
tokens inside a text become those tokens' ids, as the tokenizers library does; null ids
decode to an empty text; kept columns may have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.pretoken import PATTERN, ChunkIds, byte_alphabet, chunk_lists

CACHED_CHUNKS = 250_000
CACHED_WORDS = 150_000
#: Slots of the table of tested pairs; a slot holds the latest pair of its hash.
PAIR_BITS = 19
#: Longer words, in bytes, are encoded one by one.
LONG_WORD = 192
_ROOT, _NONE = -2, -1
_NEVER = 1 << 62


class PrefixBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file's text."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        if parsed.get("normalizer") or parsed["pre_tokenizer"]["type"] != "ByteLevel" or parsed["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE vocabularies are covered")
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.alphabet = byte_alphabet()
        # bytes to characters by way of latin-1; byte 255 is not in UTF-8 and sets words apart
        self.printable = {b: c for b, c in enumerate(self.alphabet)} | {255: " "}
        to_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        top = max([*ids.values(), *self.added.values()]) + 1
        raw = [b""] * top
        for t, i in ids.items():
            raw[i] = bytes(to_byte[c] for c in t) if t not in self.added else t.encode()
        for t, i in self.added.items():
            raw[i] = t.encode()
        self.token_bytes = pa.array(raw, pa.binary())

        #: By id: the merge that makes a token (bytes come first), and the two tokens it joins.
        self.made = np.full(top, -1, np.int64)
        self.left, self.right = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        pairs = np.zeros(len(merges), np.uint64)
        for rank, (a, b) in enumerate(merges):
            whole, pairs[rank] = ids[a + b], ids[a] << 32 | ids[b]
            if self.left[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
        self.merge_rank = np.argsort(pairs, kind="stable")
        self.merge_key = pairs[self.merge_rank]
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, 1 << 63, np.uint64), np.zeros(1 << PAIR_BITS, bool)

        ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if token not in self.added and _merged(token, ranks) == [token]:
                self.automaton.add_word(token, i << 16 | len(token))
        self.automaton.make_automaton()
        self.known_words = ChunkIds(self.word_ids, CACHED_WORDS)
        self.chunks = ChunkIds(self.chunk_ids, CACHED_CHUNKS)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of both tokens' joined bytes is these two tokens, for each pair."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            ok[new] = self._tested(left[new], right[new])
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def _tested(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes the two apart again at their seam, latest merge first (at equal merges the
        right one, as BPE merges from the left).  If the two tokens at the seam had a merge
        of their own that came before the one just undone, BPE would have taken it."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        undone, by_right = np.full(len(a), _NEVER), np.zeros(len(a), bool)
        while len(at):
            key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
            found = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            rank = np.where(self.merge_key[found] == key, self.merge_rank[found], 2 * _NEVER - 1)
            bad = (rank < undone) | ((rank == undone) & by_right)
            ok[at[bad]] = False
            on = ~bad & ((self.left[a] >= 0) | (self.left[b] >= 0))
            at, a, b = at[on], a[on], b[on]
            by_right = self.made[b] >= self.made[a]
            undone = np.where(by_right, self.made[b], self.made[a])
            a, b = np.where(by_right, a, self.right[a]), np.where(by_right, self.left[b], b)
        return ok

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of pre-tokens: last token of every prefix, then the back-pointers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        line = b"\xff".join(words).decode("latin-1").translate(self.printable)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2)
        end, token, length = hits[:, 0] + 1, hits[:, 1] >> 16, hits[:, 1] & 0xFFFF
        place = end - first[np.searchsorted(first, end - 1, side="right") - 1]
        order = np.argsort(place, kind="stable")
        end, token, length = end[order], token[order], length[order]
        last, size = np.full(len(line) + 2, _NONE, np.int64), np.zeros(len(line) + 2, np.int64)
        last[first] = _ROOT
        levels = np.cumsum(np.bincount(place))
        for lo, hi in zip(levels[:-1], levels[1:]):
            e, t, n = end[lo:hi], token[lo:hi], length[lo:hi]
            before = last[e - n]
            ok = before == _ROOT
            inner = np.flatnonzero(before >= 0)
            ok[inner] = self.compatible(before[inner], t[inner])
            last[e[ok]], size[e[ok]] = t[ok], n[ok]
        at, whose = first + lengths, np.arange(len(words))
        steps = []
        while len(at):
            on = at > first[whose]
            at, whose = at[on], whose[on]
            steps.append((whose, last[at]))
            at = at - size[at]
        whose = np.concatenate([w for w, _ in reversed(steps)] or [np.empty(0, np.int64)])
        found = np.concatenate([t for _, t in reversed(steps)] or [np.empty(0, np.int64)])
        return found[np.argsort(whose, kind="stable")].astype(np.int32), np.bincount(whose, minlength=len(words))

    def long_word(self, word: bytes) -> bytes:
        """The same recurrence along one long word, with memory for its prefixes only."""
        last, size, found = [_NONE] * (len(word) + 1), [0] * (len(word) + 1), 0
        for at, value in self.automaton.iter(word.decode("latin-1").translate(self.printable)):
            end, token, length = at + 1, value >> 16, value & 0xFFFF
            if end == found:
                continue  # a prefix has one last token only
            before = last[end - length]
            if end > length and (before < 0 or not self.compatible(np.array([before]), np.array([token]))[0]):
                continue
            last[end], size[end], found = token, length, end
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= size[end]
        return np.array(out[::-1], np.int32).tobytes()

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of any text; added tokens stand alone."""
        if self.added_pattern is None:
            return PATTERN.findall(text)
        cut = self.added_pattern.split(text)
        return [x for i, part in enumerate(cut) for x in ([part] if i % 2 else PATTERN.findall(part))]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        # a space and ASCII letters are one pre-token; the pattern decides the others
        cut = [(c,) if c.isascii() and c.replace(" ", "", 1).isalpha() and c.rfind(" ") < 1 else self.pieces(c) for c in chunks]
        words = list(set(chain.from_iterable(cut)))
        known = dict(zip(words, self.known_words.of(words)))
        return [known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c]) for c in cut]

    def word_ids(self, words: list[str]) -> list[bytes]:
        data = [w.encode("utf-8", "replace") for w in words]
        out = [np.int32(self.added[w]).tobytes() if w in self.added else self.long_word(b) if len(b) > LONG_WORD else None for w, b in zip(words, data)]
        short = [i for i, x in enumerate(out) if x is None]
        if short:
            ids, n = self.words([data[i] for i in short])
            every, ends = ids.tobytes(), 4 * np.cumsum(n)
            for i, lo, hi in zip(short, (ends - 4 * n).tolist(), ends.tolist()):
                out[i] = every[lo:hi]
        return out

    def encode_texts(self, texts: pa.Array) -> pa.ListArray:
        return self.chunks.lists(chunk_lists(texts, self.pieces, self.added))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The texts that the ids stand for; bytes that are no UTF-8 are replaced."""
        flat = self.token_bytes.take(ids.flatten())
        ends = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        out = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(bounds)), data])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = pa.Array.from_buffers(pa.binary(), len(ids), out.buffers())
            out = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].as_py()

    def decode(self, ids: list[int]) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def _merged(chars: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Plain BPE of a short string: the lowest-ranked adjacent pair merges first."""
    parts = list(chars)
    while len(parts) > 1:
        rank, i = min((ranks.get((parts[i], parts[i + 1]), _NEVER), i) for i in range(len(parts) - 1))
        if rank == _NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


_loaded: dict[int, PrefixBpe] = {}


def vocabulary(spec: str) -> PrefixBpe:
    """One instance per Python worker, so its caches outlive a task."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PrefixBpe(spec)
    return _loaded[key]


#: Rows whose ids leave a task together.
_ROWS_OUT = 1024


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_OUT):
            yield batch.slice(lo, _ROWS_OUT)


def _encode(spec_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec_ref.value)
        for part in _parts(batches):
            ids = bpe.encode_texts(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return run


def _decode(spec_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec_ref.value)
        for part in _parts(batches):
            texts = bpe.decode_lists(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return run


def _round_trip(spec_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec_ref.value)
        for part in _parts(batches):
            ids = bpe.encode_texts(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, bpe.decode_lists(ids)], names=[*part.schema.names[:-1], "ids", "decoded"])

    return run


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(docs: DataFrame, spec: str, text_col: str, keep: tuple[str, ...], *new: str):
    if taken := {*keep} & {*new}:
        raise ValueError(f"kept columns {sorted(taken)} have the names of new ones")
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows, shape, docs.sparkSession.sparkContext.broadcast(spec)


def round_trip(docs: DataFrame, spec: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded`` in one pass: one vocabulary per core, not two."""
    rows, shape, ref = _texts(docs, spec, text_col, keep, "ids", "decoded")
    return rows.mapInArrow(_round_trip(ref), f"{shape}, ids array<int>, decoded string")


def encoded(docs: DataFrame, spec: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``: exact token ids of every whole text."""
    rows, shape, ref = _texts(docs, spec, text_col, keep, "ids")
    return rows.mapInArrow(_encode(ref), f"{shape}, ids array<int>")


def decoded(tokens: DataFrame, spec: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded``: the text that the ids stand for."""
    if taken := {*keep} & {"ids", "decoded"}:
        raise ValueError(f"kept columns {sorted(taken)} have the names of new ones")
    ref = tokens.sparkSession.sparkContext.broadcast(spec)
    rows = tokens.select(*keep, "ids")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(ref), f"{shape}, decoded string")
