"""Byte-pair encoding and decoding with a contiguous rank array.

A short word is held as its part boundaries and the ranks of adjacent parts. Each step scans the ranks
for the minimum, deletes that boundary and refreshes the two neighbouring ranks, until no rank is left.
The scan would be quadratic on long words: those of more than ``SHORT`` parts keep the same ranks in a heap over linked parts,
and merge in the same order. Ranks come from the merge list of a tokenizer file, whose path is a parameter.

Null text counts as empty: no ids, decoded text empty. Repeated rows are encoded alike; other columns
are not read. A text is one row of one task whatever its length; a word of a megabyte takes seconds. A part that
the vocabulary lacks is an error.
"""

from __future__ import annotations

import hashlib
from array import array
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_map, small_batches
from .tokens import Encoder, checked, spell

NEVER = 1 << 30
#: The most parts of a word in the rank array.
SHORT = 256


class RankArray:
    """The BPE model of a tokenizer file: merge ranks, ids and tokens."""

    def __init__(self, path: str, kind: str = "word"):
        model = checked(path, kind)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.id = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}

    def parts(self, word: str) -> list[str]:
        """The parts of a word that is spelt in the byte alphabet."""
        part = [*word[:-1], word[-1] + self.end] if word else []
        if len(part) > SHORT:
            return self._long(part)
        rank_of = self.rank.get
        rank = [rank_of(p, NEVER) for p in zip(part, part[1:])]
        while rank and (least := min(rank)) < NEVER:
            i = rank.index(least)
            part[i] += part.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = rank_of((part[i], part[i + 1]), NEVER)
            if i:
                rank[i - 1] = rank_of((part[i - 1], part[i]), NEVER)
        return part

    def _long(self, part: list[str]) -> list[str]:
        """The same merges from a heap of (rank, place); an entry whose parts have changed since is passed over."""
        n, rank_of = len(part), self.rank.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := rank_of((a, b))) is not None]
        heapify(heap)

        def meet(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank_of((part[i], part[j]))) is not None:
                heappush(heap, (r, i, part[i], part[j]))

        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            meet(before[i], i)
            meet(i, after[i])
        return [p for p in part if p]

    def ids(self, word: str) -> bytes:
        whole = self.id.get(word + self.end) if len(word) == 1 else None
        return array("H", [whole] if whole is not None else [self.id[p] for p in self.parts(word)]).tobytes()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, kind: str):
        model = RankArray(path, kind)
        self.encoder = Encoder(path, kind, lambda word: model.ids(spell(word)))
        vocabulary = self.encoder.library.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = token
        self.digits = [str(i) for i in range(len(self.token))]

    def encode(self, text: str | None) -> array:
        return array("H", self.encoder.ids(text))

    def decode(self, ids: array) -> str:
        """Tokens joined by a space: this vocabulary has no decoder of its own."""
        return " ".join(map(self.token.__getitem__, ids))


_kept: dict = {}


def codec(path: str, kind: str) -> Codec:
    if (path, kind) not in _kept:
        _kept[path, kind] = Codec(path, kind)
    return _kept[path, kind]


def encode_decode(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """doc_id, ids, decoded: the ids of every whole text and the text they decode to."""
    small_batches(docs.sparkSession)

    def make():
        c = codec(path, kind)

        def each(rows: dict) -> dict:
            ids = [c.encode(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "ids": ids, "decoded": [c.decode(i) for i in ids]}

        return each

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded text, taken where they are made."""
    small_batches(docs.sparkSession)

    def make():
        c = codec(path, kind)

        def sha(x: str) -> str:
            return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

        def each(rows: dict) -> dict:
            out: dict = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                ids = c.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(" ".join(map(c.digits.__getitem__, ids))))
                out["decoded_sha256"].append(sha(c.decode(ids)))
            return out

        return each

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
