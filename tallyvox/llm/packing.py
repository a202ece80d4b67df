"""Packing of token sequences into windows of fixed length by the sum-of-squares rule.

Each document goes, whole, to the fill level that keeps the sum of the squared counts of partially filled windows
least: with counts N[h] in a level array, moving a window from level h to h + size changes the sum by
2 * (N[h + size] - N[h]) + 2, and a full window counts nothing. Documents beyond a window give full windows first.
Every task packs the rows of its own partition, in batches of bounded size, so nothing is shuffled; what is left
open at the end of a batch is merged, cutting documents, and the last rest is split into windows whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, text_list

WINDOW, END = 4096, 2
#: Tokens after which a task closes its open windows: its memory is bounded by this and the longest document.
BATCH_TOKENS = 1 << 23


class SumOfSquares:
    """Open windows by level. place() puts a piece of at most window tokens and returns a window that it has filled, or None."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # count[0] and count[window] stay 0
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, piece: tuple, size: int) -> list | None:
        levels = self.count[: self.window - size + 1]
        gain = self.count[size:] - levels  # of level h, 0 is a new window
        gain[1:][levels[1:] == 0] = np.iinfo(np.int64).max
        gain[-1] -= size < self.window and gain[-1] < np.iinfo(np.int64).max  # a full window adds no square of its own
        best = int(np.argmin(gain[::-1]))
        level = self.window - size - best  # of equal gains, the fullest
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first; none is open afterwards."""
        out = [p for level in sorted(self.open, reverse=True) for p in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        return out


def merged(windows: list[list], window: int) -> Iterator[list]:
    """Fill the gaps of the fullest windows with cut pieces of the emptiest; the last rest becomes windows of power-of-two length."""
    loose: list[tuple] = []
    low, high = len(windows), 0
    while high < low:
        pieces = windows[high]
        high += 1
        gap = window - sum(n for _, _, n in pieces)
        while gap and (loose or high < low):
            if not loose:
                low -= 1
                loose = windows[low][::-1]
            doc, start, n = loose.pop()
            take = min(gap, n)
            pieces.append((doc, start, take))
            gap -= take
            if take < n:
                loose.append((doc, start + take, n - take))
        if not gap:
            yield pieces
            continue
        left = pieces[::-1]
        total = window - gap
        for bit in range(total.bit_length() - 1, -1, -1):
            room, part = (1 << bit) & total, []
            while room:
                doc, start, n = left.pop()
                take = min(room, n)
                part.append((doc, start, take))
                room -= take
                if take < n:
                    left.append((doc, start + take, n - take))
            if part:
                yield part
    if loose:  # the fullest windows took a part of the last
        yield from merged([loose[::-1]], window)


def pack(lengths: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (number of the document, start, length); every token of every document is in one of them."""
    packer = SumOfSquares(window)
    for i, n in enumerate(lengths):
        whole = n - n % window
        for start in range(0, whole, window):
            yield [(i, start, window)]
        if n > whole and (full := packer.place((i, whole, n - whole), n - whole)):
            yield full
    yield from merged(packer.rest(), window)


#: The tokenizer that words can be cached for: it lower-cases, drops white space and ends a token at each change between
#: letters, digits and other characters. The words of any other tokenizer may hang together, so it reads whole texts.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Punctuation that ends a word, after a-z or 0-9, is a token candidate of its own for such a tokenizer.
_TAIL, _BEFORE_TAIL = b".,;:!?$#*", frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Small Latin letters: one token candidate, equal to their normal form.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Where lower-casing A-Z first could change a result: marks (U+0300 to U+037F) that compose with small letters only, and what may be an added token.
_AS_IT_IS = (b"\xcc", b"\xcd", b"<|")
#: How a byte-level vocabulary writes the two bytes of the letters of _PLAIN: bytes 0x80 to 0xA0 are moved to U+0122 and on, 0xAD to U+0143, others stay.
_AS_BYTES = {c: "\u00c3" + chr(low + 0xA2 if low <= 0xA0 else 0x143 if low == 0xAD else low) for c in range(0xDF, 0x100) for low in [0x80 | c & 0x3F]}


class TokenIds:
    """Token ids of texts, each followed by end_id.

    For a tokenizer of the kind above the ids of a text are those of its words in order, so words are cached, in two
    generations: when the young one is full it becomes the old one, and what is met again moves back. Small Latin
    letters are one token candidate and go to the vocabulary's merges at once; all else takes the tokenizer's whole way.
    """

    def __init__(self, path: str, end_id: int, remember: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark keeps the cores busy already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, bytewise = ([*(spec["pre_tokenizer"] or {}).get("pretokenizers", []), {}, {}])[:2]
        self.by_words = (
            (spec["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER
            and split == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
            and bytewise == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        self.end, self.remember = np.array([end_id], "<u4").tobytes(), remember
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.by_words:
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None}))

    def _ids(self, tokenizer: object, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Add the ids of words that neither generation has."""
        ended = [w for w in words if w[-1] in _TAIL and (stem := w.rstrip(_TAIL)) and stem[-1] in _BEFORE_TAIL]
        words.difference_update(ended)
        stems = [w.rstrip(_TAIL) for w in ended]
        tails = [w[len(stem) :] for w, stem in zip(ended, stems, strict=True)]
        for parts in (stems, tails):
            words.update(x for x in parts if x not in self.young and not self.kept(x))
        plain = [w for w in words if w.isalpha() and w.islower()]  # ASCII letters
        words.difference_update(plain)
        other = [(w, w.decode()) for w in words]
        latin = [x for x in other if _PLAIN.fullmatch(x[1])]
        other = [x for x in other if not _PLAIN.fullmatch(x[1])]
        young = self.young
        young.update(zip(plain, self._ids(self.merges, [w.decode() for w in plain]), strict=True))
        young.update(zip((w for w, _ in latin), self._ids(self.merges, [x.translate(_AS_BYTES) for _, x in latin]), strict=True))
        young.update(zip((w for w, _ in other), self._ids(self.tokenizer, [x for _, x in other]), strict=True))
        for w, stem, tail in zip(ended, stems, tails, strict=True):
            young[w] = young[stem] + young[tail]

    def kept(self, word: bytes) -> bool:
        """Whether the old generation has the word, which then moves to the young one."""
        ids = self.old.get(word)
        if ids is not None:
            self.young[word] = ids
        return ids is not None

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.frombuffer(ids + self.end, "<u4") for ids in self._ids(self.tokenizer, [t or "" for t in texts])]
        if len(self.young) > self.remember:
            self.young, self.old = {}, self.young
        words, ends = [], []
        for t in texts:
            raw = (t or "").encode()
            words += (raw if any(x in raw for x in _AS_IT_IS) else raw.lower()).split()  # bytes.lower() and split() know ASCII only
            ends.append(len(words))
        ids = list(map(self.young.get, words))
        missed = [i for i, x in enumerate(ids) if x is None]
        if missed:
            self.learn({w for w in {words[i] for i in missed} if not self.kept(w)})
            for i in missed:
                ids[i] = self.young[words[i]]
        return [np.frombuffer(b"".join([*ids[a:b], self.end]), "<u4") for a, b in zip([0, *ends], ends)]


_TOKENS: dict[tuple[str, int], TokenIds] = {}


def token_ids(path: str, end_id: int) -> Callable[[list[str | None]], list[np.ndarray]]:
    if (path, end_id) not in _TOKENS:  # a Python worker serves many tasks
        _TOKENS[path, end_id] = TokenIds(path, end_id)
    return _TOKENS[path, end_id]


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END, batch_tokens: int = BATCH_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A text's ids are those of the tokenizer, then end_id; a null or empty text has end_id only. Sequences hold window
    tokens, but for a few whose lengths are powers of two. sequence_id joins the partition and a running number, so it
    names a sequence within one run; which documents meet in one depends on how docs is partitioned. Every row is a
    document of its own: rows that repeat a doc_id, or have none, give pieces each. Other columns of docs are ignored,
    whatever their names. An empty table gives no rows.
    """
    size = 2 ** 32

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path, end_id)
        sequence = TaskContext.get().partitionId() * size
        ids: list[np.ndarray] = []
        docs_held: list[int | None] = []
        total = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, total
            rows = []
            for pieces in pack([len(x) for x in ids], window):
                at = 0
                for i, start, n in pieces:
                    part = ids[i][start : start + n]
                    rows.append((docs_held[i], start, n, zlib.crc32(part), len(ids[i]), sequence, at, *([part] if with_ids else [])))
                    at += n
                sequence += 1
            ids.clear()
            docs_held.clear()
            total = 0
            if rows:
                columns = [pa.array(x, pa.int64()) for x in islice(zip(*rows, strict=True), 7)]
                if with_ids:
                    columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in small(batches):
            found = encode(text_list(batch))
            ids += found
            docs_held += batch.column("doc_id").to_pylist()
            total += sum(map(len, found))
            if total >= batch_tokens:
                yield from close()
        yield from close()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, schema)
