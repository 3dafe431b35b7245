"""BPE encoding and decoding (operator 9).

Every word holds its parts and the merge ranks of adjacent parts in two contiguous
arrays. The smallest rank is found by a scan, the boundary inside its pair is deleted,
and the ranks to its left and right are looked up again, until no pair has a rank. A
scan is cheaper than a heap for the few parts that a word has; a word of more than
LONG_WORD bytes uses a heap over linked parts, with the same merges in the same order.

Null and empty texts have no tokens and decode to the empty text. Rows are independent:
repeated rows and repeated ids give repeated results, and an empty table gives an empty
one. Only the two named columns are read, so other columns can have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

#: Words of more bytes than this are merged with a heap.
LONG_WORD = 192
#: A task keeps the tokens of so many different words.
WORDS_KEPT = 300_000
NO_RANK = 1 << 60
#: The splitting pattern of byte-level BPE. White space is Unicode's.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary, from the text of a tokenizers JSON file."""

    def __init__(self, file_text: str):
        told = json.loads(file_text)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.piece = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items()}
        self.first = [vocabulary[c] for c in letters]
        self.merge = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", ())}
        for text, i in self.special.items():
            self.piece[i] = text.encode()
        self.split = regex.compile(PATTERN)
        ordered = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.known: dict[str, bytes] = _Known(self)

    def word(self, raw: bytes) -> list[int]:
        """Token ids of one word."""
        if len(raw) > LONG_WORD:
            return self._long_word(raw)
        parts = [self.first[b] for b in raw]
        find = self.merge.get
        none = (NO_RANK, 0)
        found = [find(p, none) for p in zip(parts, parts[1:])]
        ranks = [f[0] for f in found]
        made = [f[1] for f in found]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[i]
            del parts[i + 1], ranks[i], made[i]
            if i < len(ranks):
                ranks[i], made[i] = find((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1], made[i - 1] = find((parts[i - 1], parts[i]), none)
        return parts

    def _long_word(self, raw: bytes) -> list[int]:
        parts: list[int | None] = [self.first[b] for b in raw]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (f := self.merge.get((parts[i], parts[j]))):
                heapq.heappush(heap, (f[0], i, parts[i], parts[j], f[1]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = new, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of text as little-endian unsigned 32-bit integers."""
        known, find = self.known, self.split.findall
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(known.__getitem__, find(text)))
        made = []
        for part in self.cut.split(text):
            if part in self.special:
                made.append(self.special[part].to_bytes(4, "little"))
            else:
                made += map(known.__getitem__, find(part))
        return b"".join(made)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    def decode(self, ids) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """Tokens of words met before, as bytes; emptied when it has WORDS_KEPT words."""

    def __init__(self, model: ByteBpe):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = array("I", self.model.word(word.encode()))
        made = ids.tobytes() if ids.itemsize == 4 else np.array(ids, "<u4").tobytes()
        self[word] = made
        return made


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; executors get its text by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token ids (array<int>) and the text that they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = ByteBpe(shared.value)

        def run(ids, texts):
            tokens = [model.encode(t) for t in texts]
            return {id_col: ids, "ids": tokens, "decoded": [model.decode(t) for t in tokens]}

        return run

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, ids array<int>, decoded string", make)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the ids and of the decoded text: encode() for checks.

    ids are hashed as little-endian unsigned 32-bit integers, the text as UTF-8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = ByteBpe(shared.value)

        def digest(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        def run(ids, texts):
            coded = [model.encode_bytes(t) if t else b"" for t in texts]
            return {
                id_col: ids,
                "n_tokens": [len(c) // 4 for c in coded],
                "ids_sha256": [digest(c) for c in coded],
                "decoded_sha256": [
                    digest(model.decode(np.frombuffer(c, "<u4").tolist()).encode()) for c in coded
                ],
            }

        return run

    return map_rows(
        docs.select(id_col, text_col),
        f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        make,
    )


def op9(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.json"))
    return encode_digests(docs.select(F.col("doc_id"), F.col("text")), vocabulary)
