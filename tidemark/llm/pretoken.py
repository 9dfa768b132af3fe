"""Splitting texts for a byte-level BPE: shared by the encoder and the id writer.

A batch of texts is cut into chunks that encode alone, the chunks are told apart once per
batch by Arrow's dictionary encoding, and only distinct chunks reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The public byte-level pattern: contractions, letters, numbers, other marks, white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: What the chunk shortcut does not cover: spaces at an end, runs of them, any but space and newline.
_UNEASY = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Longer chunks are not worth a place in a cache.
LONGEST_CACHED = 64


def chunk_lists(texts: pa.Array, hard: Callable[[str], list[str]], added: Iterable[str] = ()) -> pa.ListArray:
    """The chunks of each text: cut before single spaces, around single newlines and between
    an ASCII letter or digit and a mark.

    No pattern match crosses such a cut, because a lone space between two other
    characters always starts a match and a lone newline always is one.  Texts with other
    white space or with an added token are cut by ``hard`` instead.  Nulls are empty.
    """
    texts = pc.fill_null(texts, "")
    uneasy = pc.match_substring_regex(texts, _UNEASY)
    for token in added:
        uneasy = pc.or_(uneasy, pc.match_substring(texts, token))
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    # a run of letters or of digits ends where a mark begins
    marked = pc.replace_substring_regex(marked, "([0-9A-Za-z])([,.;:!?])", "\\1\0\\2")
    if not pc.any(uneasy).as_py():
        return pc.split_pattern(marked, "\0")
    easy = pc.split_pattern(marked.filter(pc.invert(uneasy)), "\0")
    other = pa.array([hard(t) for t in texts.filter(uneasy).to_pylist()], easy.type)
    is_hard = uneasy.to_numpy(zero_copy_only=False)
    place = np.where(is_hard, len(easy) + np.cumsum(is_hard) - 1, np.cumsum(~is_hard) - 1)
    return pa.concat_arrays([easy, other]).take(pa.array(place))


class Learnt:
    """Values of words or chunks; ``learn`` makes those of new ones in bulk.

    The cache has two generations: when the young one is full it becomes the old one, whose
    entries come back on use.  At most twice ``most`` entries; what it drops is made anew.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int):
        self.learn, self.most = learn, most
        self.young: dict = {}
        self.old: dict = {}

    def of(self, distinct: list[str]) -> list:
        out = list(map(self.young.get, distinct))
        absent = [i for i, value in enumerate(out) if value is None]
        new = []
        for i in absent:
            out[i] = self.old.get(distinct[i])
            if out[i] is None:
                new.append(i)
        if new:
            for i, value in zip(new, self.learn([distinct[i] for i in new])):
                out[i] = value
        if len(self.young) + len(absent) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((distinct[i], out[i]) for i in absent[: self.most] if len(distinct[i]) <= LONGEST_CACHED)
        return out


class ChunkIds(Learnt):
    """Ids of chunks as int32 bytes."""

    def lists(self, chunks: pa.ListArray) -> pa.ListArray:
        """The ids of every text, from its chunks."""
        named = chunks.flatten().dictionary_encode()
        parts = self.of(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        code = named.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        first = (np.cumsum(sizes) - sizes)[code]
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        ids = np.frombuffer(b"".join(parts), np.int32)[at]
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[offsets].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))


@lru_cache(maxsize=4)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return tuple(chr(b if b in plain else next(extra)) for b in range(256))
