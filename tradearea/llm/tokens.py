"""Token counts by greedy longest match in linear time, without building a piece.

The vocabulary is a trie. Where a word leaves it, a failure link leads to the state reached after the longest
tokens of what was read are taken off, and a precomputed number says how many tokens that is. A word is one
walk: take edges, follow failure links and add their numbers. All words of a piece of text walk side by
side in numpy, each distinct word once.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.llm.words import SPACED, Piece, per_row, slices

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: the symbol behind the last byte of a word
END = 256
MOST_TOKENS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            letters[chr(256 + len(letters) - len(plain))] = b
    return letters


def read_vocabulary(path: str = VOCABULARY, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """Tokens as symbols: bytes, and END where a token ends a word. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    letters, out = byte_letters(), []
    for token in model["model"]["vocab"]:
        if token not in special:
            ends = token.endswith(word_end)
            body = token.removesuffix(word_end) if ends else token
            if body and all(c in letters for c in body):
                out.append((*(letters[c] for c in body), *((END,) if ends else ())))
    return out


class Automaton:
    """Trie with failure links; edges are sorted numbers state * 257 + symbol."""

    def __init__(self, tokens: Iterable[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for n, token in enumerate(tokens):
            if n >= MOST_TOKENS:
                raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens is not sent to the tasks")
            state = 0
            for symbol in token:
                nxt = children[state].get(symbol)
                if nxt is None:
                    nxt = children[state][symbol] = len(children)
                    children.append({})
                    final.append(False)
                state = nxt
            final[state] = True
        # -1: the word can't be cut here
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, state in children[parent].items():
                queue.append(state)
                if final[state]:
                    fail[state], pops[state] = 0, 1
                    continue
                at, popped = fail[parent], pops[parent]
                while at >= 0 and symbol not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[state], pops[state] = children[at][symbol], popped
        edges = sorted((state * 257 + symbol, to) for state, own in enumerate(children) for symbol, to in own.items())
        self.edges = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([t for _, t in edges] + [0], np.int32)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span of bytes; 0 where the vocabulary can't cut it."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those at work are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        bad = np.zeros(len(order), bool)
        work = len(order)
        for place in range(int(lengths[0]) + 1 if len(order) else 0):
            while work and lengths[work - 1] < place:
                work = int(np.searchsorted(-lengths, -place, side="right"))
            inside = lengths[:work] > place
            symbol = np.full(work, END, np.int64)
            symbol[inside] = data[starts[:work][inside] + place]
            self._step(np.flatnonzero(~bad[:work]), symbol, state, count, bad)
        # what is left is taken off down to the root
        left = np.flatnonzero(~bad & (state > 0))
        while len(left):
            count[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
            bad[left[state[left] < 0]] = True
            left = left[state[left] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(bad, 0, count)
        return out

    def _step(self, walk: np.ndarray, symbol: np.ndarray, state: np.ndarray, count: np.ndarray, bad: np.ndarray) -> None:
        while len(walk):
            key = state[walk] * 257 + symbol[walk]
            at = np.searchsorted(self.edges, key)
            found = self.edges[at] == key
            state[walk[found]] = self.to[at[found]]
            walk = walk[~found]
            count[walk] += self.pops[state[walk]]
            state[walk] = self.fail[state[walk]]
            lost = state[walk] < 0
            bad[walk[lost]] = True
            walk = walk[~lost]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_tokens, n_unknown.

    Words stand between ASCII white space, with A-Z in lower case. A word that the vocabulary can't cut is one
    unknown token. Null, empty and blank texts have no tokens. Other columns are passed over.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in slices(batches, "_text"):
            piece = Piece(batch.column("_text"), lower=True)
            starts, ends, first = piece.spans(SPACED)
            _, one, which = np.unique(piece.hashes(starts, ends), return_index=True, return_inverse=True)
            each = automaton.counts(piece.data, starts[one], ends[one])[which]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.diff(first).astype(np.int64)),
                 pa.array(per_row(np.maximum(each, 1), first)), pa.array(per_row(each == 0, first))],
                names=["_key", "n_words", "n_tokens", "n_unknown"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("_key", key)
