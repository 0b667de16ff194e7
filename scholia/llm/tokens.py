"""Token ids of whole texts by the tokenizers library, inside Spark tasks.

The byte-level pre-tokenizer of these vocabularies starts a new word at every
space, at every line end and wherever a letter is followed by something else,
as long as no two white-space characters stand together. So such a text may be
cut there, each unit encoded by the library on its own, and the ids joined:
the result is what the library gives for the whole text. A batch's units are
dictionary-encoded, so that each distinct one is looked up once, and a bounded
table in each worker keeps the ids of short units met before, as numpy arrays
of some 40 bytes a unit. A text with adjacent white space or with a special
token's string is encoded whole.
"""

from __future__ import annotations

import ctypes
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import BASE, data_of, mix

#: Units that a worker keeps at most, and bytes of the longest unit that it keeps (two longs).
KEEP_UNITS, KEEP_BYTES = 1_000_000, 16
#: Characters of text that are worked on at once.
BATCH_BYTES = 1 << 20
_CUT = "\0"


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `flat` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Known:
    """Ids of at most `most` units of KEEP_BYTES bytes or fewer, found by the bytes themselves.

    The hashes are sorted; the rest is only appended to, in arrays of a fixed
    size, of which memory is taken as it is filled.
    """

    def __init__(self, most: int, wide: bool):
        self.n, self.used = 0, 0
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.starts, self.sizes = np.zeros((most, 2), np.uint64), np.zeros(most, np.int32), np.zeros(most, np.uint8)
        self.ids = np.zeros(4 * most, np.uint32 if wide else np.uint16)

    @staticmethod
    def keys(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit whether it is short enough, its bytes as two longs, and their hash."""
        data, at = data_of(units)
        sizes = np.diff(at)
        fits = sizes <= KEEP_BYTES
        padded = np.concatenate([data, np.zeros(KEEP_BYTES, np.uint8)])
        words = padded[at[:-1, None] + np.arange(KEEP_BYTES)]
        words[np.arange(KEEP_BYTES) >= sizes[:, None]] = 0
        words = words.view(np.uint64)
        return fits, words, mix(mix(words[:, 0]) + words[:, 1] * BASE)

    def find(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each unit, or -1."""
        if not self.n:
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        place = self.place[at]
        same = (self.hashes[at] == hashes) & (self.words[place] == words).all(axis=1)
        return np.where(same, place, -1)

    def add(self, words: np.ndarray, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keep new distinct units with their ids, as far as there is room; of two with one
        hash, and beside one that is kept, none."""
        starts = np.cumsum(sizes) - sizes
        room = (np.arange(1, len(sizes) + 1) <= len(self.sizes) - self.n) & (starts + sizes <= len(self.ids) - self.used)
        m = int(room.sum())
        order = np.argsort(hashes[:m], kind="stable")
        sorted_ = hashes[:m][order]
        at = np.searchsorted(self.hashes, sorted_)
        new = np.diff(sorted_, prepend=~sorted_[:1]) != 0
        if self.n:
            new &= self.hashes[np.minimum(at, self.n - 1)] != sorted_
        order, at = order[new], at[new]
        k, total = len(order), int(sizes[order].sum())
        self.hashes = np.insert(self.hashes, at, sorted_[new])
        self.place = np.insert(self.place, at, np.arange(self.n, self.n + k, dtype=np.int32))
        to = slice(self.n, self.n + k)
        self.words[to], self.sizes[to] = words[order], sizes[order]
        self.starts[to] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.ids[self.used : self.used + total] = ragged(flat, starts[order], sizes[order])
        self.n, self.used = self.n + k, self.used + total


class Encoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.specials = [a.content for a in t.get_added_tokens_decoder().values()]
        self.known = Known(KEEP_UNITS, t.get_vocab_size() > 1 << 16)
        self.by_unit = "ByteLevel" in str(t.pre_tokenizer) and "add_prefix_space=False" in str(t.pre_tokenizer) and t.normalizer is None
        self.newline = t.encode("\n", add_special_tokens=False).ids if self.by_unit else []
        self.by_unit &= len(self.newline) == 1

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _units(self, units: list[str], block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each unit has. The library is called with blocks of units,
        one to a line."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        blocks = [units[i : i + block] for i in range(0, len(units), block)]
        lines = ["\n".join(b) for b in blocks]
        plain = [x.count("\n") == len(b) - 1 and all(b) and not any(map(str.isspace, b)) for b, x in zip(blocks, lines, strict=True)]
        found = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(lines, plain, strict=True) if p], add_special_tokens=False))
        for b, p in zip(blocks, plain, strict=True):
            if p:
                ids = np.array(next(found).ids, dtype="<u4")
                ends = np.flatnonzero(ids == self.newline[0])
                if len(ends) == len(b) - 1:
                    flat.append(np.delete(ids, ends))
                    sizes.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
                    continue
            own = self._one_by_one(b)
            flat += own
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _table(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units: a flat array, and each unit's start and size in it."""
        known = self.known
        fits, words, hashes = known.keys(units)
        place = np.where(fits, known.find(words, hashes), -1)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        sizes = np.zeros(len(place), np.int64)
        sizes[old] = known.sizes[place[old]]
        flat = ragged(known.ids, known.starts[place[old]].astype(np.int64), sizes[old]).astype("<u4")
        more, sizes[new] = self._units(units.take(pa.array(new)).to_pylist())
        order = np.concatenate([old, new])
        starts = np.zeros(len(place), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        keep = fits[new] & (sizes[new] < 256)
        known.add(words[new[keep]], hashes[new[keep]], more if keep.all() else ragged(more, (np.cumsum(sizes[new]) - sizes[new])[keep], sizes[new][keep]), sizes[new][keep])
        return np.concatenate([flat, more]), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of an array of texts without nulls: all ids, and where each text's ids end."""
        whole = pa.array([not self.by_unit] * len(texts))
        if self.by_unit:
            whole = pc.match_substring_regex(texts, r"[\s\p{Z}\x0b\x{85}\x00][\s\p{Z}\x0b\x{85}\x00]|\x00|[\x0b\x1c-\x1f\x{85}]")
            for s in self.specials:
                whole = pc.or_(whole, pc.match_substring(texts, s))
        plain = pc.if_else(whole, "", texts)
        plain = pc.replace_substring_regex(plain, r"(\p{L})([^\p{L} \n])", rf"\1{_CUT}\2")
        plain = pc.replace_substring(pc.replace_substring(plain, " ", _CUT + " "), "\n", _CUT + "\n" + _CUT)
        split = pc.split_pattern(plain, _CUT)
        coded = split.flatten().dictionary_encode()
        table, starts, sizes = self._table(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        own = sizes[index]
        ends = np.cumsum(own)
        flat = ragged(table, starts[index], own)
        lasts = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        doc_ends = np.concatenate([[0], ends])[lasts]
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(rows):
            parts = np.split(flat, doc_ends[:-1])
            for r, raw in zip(rows.tolist(), self._one_by_one(texts.take(pa.array(rows)).to_pylist()), strict=True):
                parts[r] = raw
            flat, doc_ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return flat, doc_ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; kept between tasks."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: glibc keeps what numpy frees for later use; elsewhere there is no such call.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Freed memory goes back to the system, Arrow's and numpy's: workers outlive their
    tasks, and what a stage once took would stay beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_batches(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES):
    """Cut a batch into slices of about `most` bytes of text, one row at least;
    yields each slice with its texts, nulls as empty texts. Freed memory goes back
    to the system after each batch."""
    texts = pc.fill_null(batch.column(column), "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to
    give_back()
