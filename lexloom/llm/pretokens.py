"""Pre-token splitting and piece look-up for byte-level BPE, on whole batches of texts at once.

A batch of texts is one array of code points. Boundaries between pre-tokens are found with array
comparisons, every pre-token gets a multilinear hash, and only the distinct pre-tokens of a batch that
are not in the worker's bounded table are handed to the tokenizers library. Every occurrence is compared
with its table entry code point by code point, so a hash collision cannot change a result.

Null texts count as empty, empty texts have no pre-token, and strings of added tokens inside a text are
matched first, as the library does by default.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)

#: Code points handled in one array pass, and entries that a worker's table may hold before it is emptied.
BLOCK_CHARS = 1 << 19
TABLE_ENTRIES = 1 << 19


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _classes() -> np.ndarray:
    """Class of each code point; those that this Python's Unicode tables lack are UNKNOWN until they are seen."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        category = unicodedata.category(chr(cp))
        table[cp] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    table[list(WHITE_SPACE)] = SPACE
    return table


class Batch:
    """Pre-tokens of some texts: starts and lengths in `codes`, the index of the owning text, and hashes."""

    __slots__ = ("codes", "hashes", "joined", "lengths", "n_texts", "offsets", "owner", "starts")


class PretokenSplitter:
    """Splits texts as the byte-level pre-tokenizer of `path` does."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = load_tokenizer(path)
        self.classes = _classes()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.factors = np.zeros(0, np.uint64)

    def _learn(self, codes: np.ndarray) -> None:
        """Ask the library for the class of code points that are newer than this Python's tables."""
        for cp in np.unique(codes).tolist():
            for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(probe + chr(cp))) == 1:
                    self.classes[cp] = kind

    def _factors(self, n: int) -> np.ndarray:
        if len(self.factors) < n:
            size = max(1024, 1 << (n - 1).bit_length())
            self.factors = np.random.default_rng(20240229).integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        return self.factors

    def split(self, texts: list[str | None]) -> Batch:
        texts = [t or "" for t in texts]
        out = Batch()
        out.n_texts, out.joined = len(texts), "".join(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        codes = out.codes = np.frombuffer(out.joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        if not n:
            out.starts = out.lengths = out.owner = out.offsets = np.zeros(0, np.int64)
            out.hashes = np.zeros(0, np.uint64)
            return out

        forced = np.zeros(n + 1, bool)
        forced[bounds] = True
        whole = []
        if self.added:
            for i, text in enumerate(texts):
                whole += [(bounds[i] + m.start(), bounds[i] + m.end()) for m in self.added.finditer(text)]
            for a, b in whole:
                forced[a] = forced[b] = True

        kind = self.classes[codes]
        if (unknown := kind == UNKNOWN).any():
            self._learn(codes[unknown])
            kind = self.classes[codes]
        start = forced[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]

        # The last white space before other text stands alone, or with that text if it is U+0020.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~forced[1:n])
        start[last] = True
        start[last[codes[last] == 0x20] + 1] = False

        # Contractions: an apostrophe that begins a pre-token takes one or two letters with it.
        for q in np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~forced[1:n]).tolist():
            one, two = chr(codes[q + 1]), out.joined[q + 1 : q + 3]
            size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") and not forced[q + 2] else 0
            if size:
                start[q + 1] = False
                if q + 1 + size < n:
                    start[q + 1 + size] = True
        for a, b in whole:
            start[a + 1 : b] = False

        starts = out.starts = np.flatnonzero(start)
        out.lengths = np.diff(starts, append=n)
        out.owner = np.searchsorted(bounds, starts, "right") - 1
        out.offsets = np.arange(n) - np.repeat(starts, out.lengths)
        factors = self._factors(int(out.lengths.max()))
        out.hashes = np.add.reduceat((codes + np.uint32(1)) * factors[out.offsets], starts)
        return out


class PieceTable:
    """Pieces of distinct pre-tokens, looked up by hash and checked by content. Bounded by `limit` entries."""

    def __init__(self, splitter: PretokenSplitter, limit: int = TABLE_ENTRIES):
        self.splitter, self.limit = splitter, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int32)
        self.id_at = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.code_at = np.zeros(0, np.int32)
        self.codes = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where the table has none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1)

    def add(self, hashes: np.ndarray, pretokens: list[str]) -> None:
        """Encode each pre-token once with the library and keep its ids; hashes come sorted and are new."""
        encode = self.splitter.tokenizer.encode_batch_fast
        found = []
        for i in range(0, len(pretokens), 8192):
            found += [e.ids for e in encode(pretokens[i : i + 8192], add_special_tokens=False)]
        base = len(self.counts)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        sizes = np.fromiter(map(len, pretokens), np.int32, len(pretokens))
        self.id_at = np.concatenate([self.id_at, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.code_at = np.concatenate([self.code_at, (len(self.codes) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.uint32, int(counts.sum()))])
        self.codes = np.concatenate([self.codes, np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)])
        at = np.searchsorted(self.keys, hashes)
        self.slots = np.insert(self.slots, at, base + np.arange(len(hashes), dtype=np.int32))
        self.keys = np.insert(self.keys, at, hashes)

    def same(self, batch: Batch, slots: np.ndarray) -> bool:
        """Whether every pre-token with a slot (not -1) equals its table entry."""
        known = slots >= 0
        if known.all():
            at = np.repeat(self.code_at[slots] - batch.starts, batch.lengths)
            at += np.arange(len(batch.codes))
            np.minimum(at, len(self.codes) - 1, out=at)
            return bool((self.codes[at] == batch.codes).all())
        each = np.repeat(known, batch.lengths)
        at = np.repeat(np.where(known, self.code_at[slots] if len(self.code_at) else 0, 0), batch.lengths) + batch.offsets
        np.minimum(at, max(len(self.codes) - 1, 0), out=at)
        return bool((self.codes[at[each]] == batch.codes[each]).all()) if each.any() else True

    def slots_of(self, batch: Batch) -> np.ndarray:
        """Slot of every pre-token of the batch, after encoding those that were missing."""
        distinct, first, inverse = np.unique(batch.hashes, return_index=True, return_inverse=True)
        slots = self.find(distinct)
        if (missing := slots < 0).any():
            if len(self.counts) + int(missing.sum()) > self.limit or len(self.codes) > 64 * self.limit:
                self.clear()
                missing = np.ones(len(distinct), bool)
            at, size, text = batch.starts[first[missing]].tolist(), batch.lengths[first[missing]].tolist(), batch.joined
            self.add(distinct[missing], [text[a : a + n] for a, n in zip(at, size, strict=True)])
            slots = self.find(distinct)
        return slots[inverse]


class BatchEncoder:
    """Encodes lists of texts: token ids of all texts in one array, and the number of tokens of each text."""

    def __init__(self, path: str, limit: int = TABLE_ENTRIES):
        self.splitter = PretokenSplitter(path)
        self.table = PieceTable(self.splitter, limit)

    def _block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        batch = self.splitter.split(texts)
        if not len(batch.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        slots = self.table.slots_of(batch)
        if not self.table.same(batch, slots):
            found = [e.ids for e in self.splitter.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found])
        counts = self.table.counts[slots]
        ends = np.cumsum(counts)
        at = np.repeat(self.table.id_at[slots] - ends + counts, counts) + np.arange(ends[-1])
        return self.table.ids[at], np.bincount(batch.owner, counts, len(texts)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._block(block) for block in blocks(texts)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS, most: int = 1 << 14):
    """Runs of at most `most` texts, of about `chars` code points together; every text is in exactly one run."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= chars or len(block) >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    """One encoder for each Python worker, so that its table serves all tasks of the worker."""
    return BatchEncoder(path)


@lru_cache(maxsize=2)
def splitter(path: str) -> PretokenSplitter:
    return PretokenSplitter(path)
