"""Token counts (operator 10): greedy longest-match pieces of words, counted only.

The vocabulary is a trie. A node that no byte of the word continues pops what greedy
matching has settled by then: its failure link is the node of the rest, and the number
of pieces popped on the way is kept with it. A word is read once, in linear time, and no
piece is ever built.

Words are the pre-tokens of the byte-level vocabulary, whose pieces include every single
byte, so that each word is covered. Null and empty texts have no words and no tokens.
Rows are independent, so that repeated rows give repeated counts, and an empty table gives
an empty one; only the two named columns are read. A text of any length is counted in
whole, in memory that is linear in it; a word of any length in time that is.
"""

from __future__ import annotations

import json
from array import array

import regex
from pyspark.sql import DataFrame

from tessera.llm.bpe import PATTERN, byte_letters, read_vocabulary
from tessera.llm.common import map_rows

#: A task keeps the counts of so many different words.
WORDS_KEPT = 600_000


class Automaton:
    """Trie, failure links and popped counts; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        ends = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                key = at << 8 | b
                at = step.get(key) or step.setdefault(key, len(ends))
                if at == len(ends):
                    ends.append(False)
            ends[at] = True
        if any(b not in step or not ends[step[b]] for b in range(256)):
            raise ValueError("every byte has to be a piece")
        self.step, fail, pops = step, array("l", [0]) * len(ends), array("l", [0]) * len(ends)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in step.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        level = [0]
        while level:
            deeper = []
            for above in level:
                for b, at in below.get(above, ()):
                    deeper.append(at)
                    if ends[at]:
                        fail[at], pops[at] = 0, 1
                        continue
                    count, rest = pops[above], fail[above]
                    while rest << 8 | b not in step:
                        count, rest = count + pops[rest], fail[rest]
                    fail[at], pops[at] = step[rest << 8 | b], count
            level = deeper
        self.fail, self.pops = fail, pops

    def count(self, word: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        at = made = 0
        for b in word:
            while (to := step.get(at << 8 | b)) is None:
                made += pops[at]
                at = fail[at]
            at = to
        while at:
            made += pops[at]
            at = fail[at]
        return made


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        made = self[word] = self.automaton.count(word.encode())
        return made


def vocabulary_pieces(file_text: str) -> list[bytes]:
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    vocabulary = json.loads(file_text)["model"]["vocab"]
    return [bytes(map(byte_of.__getitem__, s)) for s in vocabulary if all(c in byte_of for c in s)]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counts = _Counts(Automaton(vocabulary_pieces(shared.value)))
        split = regex.compile(PATTERN).findall

        def run(ids, texts):
            found = [split(t) if t else [] for t in texts]
            return {
                id_col: ids,
                "n_words": [len(w) for w in found],
                "n_tokens": [sum(map(counts.__getitem__, w)) for w in found],
            }

        return run

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, n_words long, n_tokens long", make)


def op10(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.json"))
    return count_tokens(docs, vocabulary)
