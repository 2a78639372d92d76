"""Token ids of whole texts, through bounded per-worker caches.

Both byte-pair vocabularies cut a text into pieces before merging, and no
piece spans the place between a non-space character and a following single
space or line end.  So texts are cut there into chunks, and chunks into their
pieces.  The chunks of a group of texts are dictionary encoded by Arrow, each
distinct chunk is looked up once, and the ids of all texts are gathered from
the distinct chunks' ids in a few array operations.  Only pieces that the
caches miss go to the tokenizer, some hundreds in a call, with a separator
whose id marks the cuts.  A text with other white space or with the string of
a special token, and a chunk whose pieces are not certain, is encoded by the
tokenizer as a whole.  The ids equal those of one call per text with
``add_special_tokens=False`` (tested): like that call, the string of a special
token inside a text gives that token's id.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# bounds of a worker's memory, not of the work
CACHE_ENTRIES = 600_000  # pieces per generation
CHUNKS = 1_000_000
GROUP_BYTES = 12 << 20
ROWS_AT_ONCE = 2000  # texts of a batch whose ids a task holds together
_MARK = "\x01"
# no white space, controls or combining marks; lower case is per character
_SIMPLE = re.compile("[!-~\u00a1-\u017f]*").fullmatch
# white space other than single spaces and line ends between words
_ODD_SPACE = "^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f" + "".join(map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"


class _Cache:
    """Two generations: when the young one is full it becomes the old one, so
    what is in use stays."""

    def __init__(self, entries: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.entries = entries

    def missing(self, keys) -> list[str]:
        """The keys without a value; values in use move to the young side."""
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        new = list(filterfalse(self.young.__contains__, keys))
        if not self.old:
            return new
        kept = list(map(self.old.get, new))
        self.young.update(kv for kv in zip(new, kept, strict=True) if kv[1] is not None)
        return [k for k, v in zip(new, kept, strict=True) if v is None]


class ChunkCoder:
    """Encodes texts by chunks; subclasses say how texts and chunks are cut
    and what the ids of a piece are."""

    skip = 0  # ids at the start of a text's chunks that are not its own

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.piece_ids = _Cache(entries)
        self.most_chunks = min(CHUNKS, 2 * entries)
        # known chunks as Arrow strings, their ids one after the other
        self.known = pa.array([], pa.large_string())
        self.ids, self.many = np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def chunks(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The chunks of each text, and which texts must be encoded whole."""
        raise NotImplementedError

    def special(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of a special token."""
        return np.zeros(len(texts), dtype=bool)

    def pieces(self, chunks: list[str]) -> list[list[str] | None]:
        """The pieces of each chunk, None where they are not certain."""
        raise NotImplementedError

    def ids_of_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        raise NotImplementedError

    def ids_of_chunk(self, chunk: str) -> bytes:
        raise NotImplementedError

    def ids_of_text(self, text: str) -> bytes:
        raise NotImplementedError

    def learn_pieces(self, pieces) -> dict[str, bytes]:
        missing = self.piece_ids.missing(pieces)
        if missing:
            self.piece_ids.young.update(zip(missing, self.ids_of_pieces(missing), strict=True))
        return self.piece_ids.young

    def _learn(self, chunks: list[str]) -> list[bytes]:
        cut = self.pieces(chunks)
        get = self.learn_pieces(set(chain.from_iterable(filter(None, cut)))).__getitem__
        return [self.ids_of_chunk(k) if c is None else b"".join(map(get, c)) for k, c in zip(chunks, cut, strict=True)]

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where each distinct chunk stands among the known ones, after
        learning those that are not there."""
        if len(self.known) > self.most_chunks:  # the older half goes
            half = len(self.known) // 2
            self.ids = self.ids[self.many[:half].sum():]
            self.known, self.many = pa.concat_arrays([self.known.slice(half)]), self.many[half:]
        at = pc.index_in(keys, value_set=self.known)
        new = keys.filter(at.is_null())
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            raw = self._learn(new.to_pylist())
            out[out < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])
            self.many = np.concatenate([self.many, np.fromiter(map(len, raw), np.int32, len(raw)) >> 2])
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (nulls are empty texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1])
        out: list[np.ndarray] = []
        lo = 0
        collecting = gc.isenabled()
        gc.disable()  # millions of short lists that never form cycles
        try:
            while lo < len(texts):  # groups of bounded size, or one longer text
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), GROUP_BYTES)))
                out += self._group(texts.slice(lo, hi - lo))
                lo = hi
        finally:
            if collecting:
                gc.enable()
        return out

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        parts, whole = self.chunks(texts)
        coded = parts.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        first = (np.cumsum(self.many) - self.many)[place].astype(np.int32)
        code = coded.indices.to_numpy()
        n = self.many[place][code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first[code] - (ends - n).astype(np.int32), n) + np.arange(total, dtype=np.int32)]
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        at = np.concatenate([[0], ends])[bounds].tolist()
        out = [ids[a + self.skip:b] for a, b in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(whole | self.special(texts)).tolist():
            out[i] = np.frombuffer(self.ids_of_text(texts[i].as_py()), "<u4")
        return out


class _Library(ChunkCoder):
    """Pieces go to the tokenizers library."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__(entries)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.path, self.tok = path, None  # the full tokenizer is only loaded when a text needs it
        self.bare = Tokenizer.from_file(path)  # for pieces that are cut and normalised already
        self.marks = [t.content for t in self.bare.get_added_tokens_decoder().values()]
        self.bare.encode_special_tokens = True  # part of such a string is never a special token
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(_MARK, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self._ids(_MARK)
        if len(mark) != 1:
            raise ValueError("the separator must be one token")
        self.mark = mark[0]

    def special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), dtype=bool)
        for mark in self.marks:
            found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return found

    def _ids(self, text: str, tok=None) -> np.ndarray:
        return np.array((tok or self.bare).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def ids_of_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(pieces), 500):
            ids = self._ids(_MARK.join(pieces[lo:lo + 500]))
            at = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            for a, b in zip([0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(raw)], strict=True):
                yield raw[a:b]

    def ids_of_text(self, text: str) -> bytes:
        if self.tok is None:
            from tokenizers import Tokenizer
            self.tok = Tokenizer.from_file(self.path)
        return self._ids(text, self.tok).tobytes()


class WordCoder(_Library):
    """The lower-casing vocabulary that drops white space: chunks are the
    strings between spaces and line ends."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES // 4):
        super().__init__(path, entries)

    _cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    _cut_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall

    def chunks(self, texts: pa.Array):
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(len(texts), dtype=bool)

    def pieces(self, chunks: list[str]) -> list[list[str] | None]:
        ascii_, other = self._cut_ascii, self._cut
        return [(ascii_ if k.isascii() else other)(k.lower()) if _SIMPLE(k) else None for k in chunks]

    def ids_of_chunk(self, chunk: str) -> bytes:
        return self.ids_of_text(chunk)


def spaced_chunks(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Words keyed with the line end before them (``\\nword``; the first word
    of a text as if it followed one), a space before the others understood."""
    whole = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
    lines = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"),
                                        pa.scalar("", texts.type))
    if whole.any():
        lines = pc.if_else(pa.array(whole), pa.scalar("\n", texts.type), lines)
    return pc.split_pattern(lines, " "), whole


class ByteCoder(_Library):
    """The byte-level vocabulary."""

    skip = 1
    _cut_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
    _cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def chunks(self, texts: pa.Array):
        return spaced_chunks(texts)

    def pieces(self, chunks: list[str]) -> list[list[str] | None]:
        ascii_, other = self._cut_ascii, self._cut
        return [None if _MARK in k else (ascii_ if k.isascii() else other)(k if k[0] == "\n" else " " + k) for k in chunks]

    def ids_of_chunk(self, chunk: str) -> bytes:
        return self.ids_of_text(chunk if chunk[0] == "\n" else " " + chunk)


_coders: dict = {}


def worker_coder(kind: type, path: str):
    """One coder per Python worker."""
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path)
    return _coders[kind, path]
