"""Encoding of a corpus with a public byte-level BPE vocabulary.

A task collects the distinct words of its texts and lays their bytes out in one line of linked
symbols. An index maps every mergeable pair to all positions where it occurs; pairs are applied in
ascending order of rank, each at all its positions at once, and every merge takes its neighbours'
pairs into the index. Texts are then put together from the ids of their words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: how byte-level vocabularies split a text into words; white space as Unicode has it
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Ranks of pairs of ids and the ids they give."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.first = [0] * 256
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = len(self.result)
            self.result.append(vocab[a + b])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word."""
        symbol: list[int] = []
        starts: list[int] = []
        for word in words:
            starts.append(len(symbol))
            symbol.extend(self.first[b] for b in word.encode("utf-8", "surrogatepass"))
            symbol.append(-1)  # no pair crosses it
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, result = self.rank, self.result
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = rank.get((symbol[i], symbol[i + 1]))
            if r is not None:
                places.setdefault(r, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            at = places.pop(r)
            at.sort()
            new = result[r]
            for i in at:
                j = after[i]
                if symbol[i] == -2 or j >= n or rank.get((symbol[i], symbol[j])) != r:
                    continue  # used up by a merge before
                symbol[i], symbol[j] = new, -2
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                h = before[i]
                if h >= 0:
                    x = rank.get((symbol[h], new))
                    if x is not None:
                        if x in places:
                            places[x].append(h)
                        else:
                            places[x] = [h]
                            heapq.heappush(active, x)
                if k < n:
                    x = rank.get((new, symbol[k]))
                    if x is not None:
                        if x in places:
                            places[x].append(i)
                        else:
                            places[x] = [i]
                            heapq.heappush(active, x)
        ends = [*starts[1:], n]
        return [[s for s in symbol[a : b - 1] if s >= 0] for a, b in zip(starts, ends)]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One copy a Python worker."""
    return Merges(path)


class Encoder:
    """Encodes texts in groups; ids of words that came before are kept, up to ``most`` of them."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.table, self.most, self.known = merges(path), most, {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        split = [SPLIT.findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = list({w for words in split for w in words})
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self.known.update(zip(part, self.table.encode_words(part)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


def _groups(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_texts(df: DataFrame, text: str, keep: list[str], path: str | None = None, lengths: bool = False) -> DataFrame:
    """The columns ``keep`` and the ids of ``text`` (``ids``), or their number (``n_tokens``) with ``lengths``.

    Without special tokens. An empty and a null text have an empty list. ``path`` is the vocabulary's file,
    which every executor has. Rows stay rows: repeated ones are encoded alike, an empty table gives none.
    """
    columns = [F.col(c) for c in keep]
    shown = "n_tokens bigint" if lengths else "ids array<int>"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), shown])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path or vocabulary_path())
        for b in batches:
            kept, at = b.columns[:-1], 0
            for group in _groups(b.column(b.num_columns - 1).to_pylist()):
                ids = encode(group)
                out = pa.array([len(x) for x in ids], pa.int64()) if lengths else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(group)) for c in kept), out], [*keep, shown.split()[0]])
                at += len(group)

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)
