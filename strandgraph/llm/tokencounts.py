"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix depends on that prefix alone. So the distinct
pre-tokens of many texts are put in one trie, the forward score of each node
(the best segmentation of the characters down to it) is computed once for all
pre-tokens below it, and the number of tokens is read off where a pre-token ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandgraph.llm.common import bounded_batches
from strandgraph.llm.pieces import Pieces

#: Characters without a piece score so much less than the worst piece: a fixed value of the model format.
PENALTY = 10.0
NONE = float("-inf")
#: Nodes of a trie and counts of pre-tokens that a task keeps before it starts anew.
NODES, KEPT = 300_000, 400_000
#: Characters whose texts are counted together.
BLOCK_CHARS = 2_000_000


class Trie:
    """Pre-tokens with the forward score and token count of every prefix."""

    def __init__(self, pieces: Pieces):
        self.scores = pieces.scores
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.scores.items():
            self.automaton.add_word(piece, (len(piece) - 1, score))
        self.automaton.make_automaton()
        self.fallback = bool(pieces.bytes_)
        self.unknown = min(pieces.scores.values(), default=0.0) - PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token, whose prefixes become nodes.

        Of equal scores the one with the longest last piece counts. A character
        without a piece counts as its UTF-8 bytes if there are byte pieces, else as one.
        """
        path, children = [0], self.children
        for char in word:
            child = children.get((path[-1], char))
            if child is None:
                break
            path.append(child)
        if len(path) <= len(word):
            self._grow(word, path)
        return self.count[path[-1]]

    def _grow(self, word: str, path: list[int]) -> None:
        """Nodes for the characters behind the shared prefix ``path``, from the pieces that end at each of them."""
        children, score, count = self.children, self.score, self.count
        shared, n, first = len(path) - 1, len(word), len(score)
        path.extend(range(first, first + n - shared))
        for place in range(shared, n):
            children[path[place], word[place]] = path[place + 1]
        score.extend([NONE] * (n - shared))
        count.extend([0] * (n - shared))
        bare = iter([place for place in range(shared, n) if word[place] not in self.scores])
        waiting = next(bare, n)
        # Matches come by their end, and of one end the longest first.
        for end, (back, gain) in self.automaton.iter(word):
            if end < shared:
                continue
            while waiting < end:
                self._alone(word, path, waiting)
                waiting = next(bare, n)
            start, node = path[end - back], path[end + 1]
            total = score[start] + gain
            if total > score[node]:
                score[node] = total
                count[node] = count[start] + 1
        while waiting < n:
            self._alone(word, path, waiting)
            waiting = next(bare, n)

    def _alone(self, word: str, path: list[int], place: int) -> None:
        """A character without a piece: its bytes or one token, unless a longer piece that ends in it is at least as good."""
        parent, node = path[place], path[place + 1]
        alone = self.score[parent] + self.unknown
        if alone > self.score[node]:
            width = len(word[place].encode("utf-8", "surrogatepass")) if self.fallback else 1
            self.score[node], self.count[node] = alone, self.count[parent] + width


def with_counts(df: DataFrame, text: str, pieces: Pieces) -> DataFrame:
    """Replace the text column by n_tokens and n_pretokens. Null and empty texts have 0 of both.

    Texts stay where they are; nothing is shuffled. Every block of texts puts its
    distinct new pre-tokens into the trie of the task, in sorted order, and adds up
    their counts. A trie that has grown too large is started anew, which costs time
    but changes no count.
    """
    kept = [c for c in df.columns if c != text]
    added = [("n_tokens", T.LongType(), pa.int64()), ("n_pretokens", T.LongType(), pa.int64())]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(pieces), {}
        for batch in batches:
            sums, words = [], []
            block: list[list[str]] = []
            chars = 0

            def flush():
                new = set().union(*block) - known.keys()
                for word in sorted(new):
                    if len(trie.score) > NODES:
                        trie.clear()
                    known[word] = trie.tokens(word)
                sums.extend(sum(map(known.__getitem__, segments)) for segments in block)
                words.extend(map(len, block))
                if len(known) > KEPT:
                    known.clear()
                block.clear()

            for value in batch.column(text):
                whole = value.as_py() or ""
                block.append(pieces.segments(whole))
                chars += len(whole)
                if chars > BLOCK_CHARS:
                    flush()
                    chars = 0
            flush()
            columns = [*(batch.column(c) for c in kept), *(pa.array(c, kind) for c, (_, _, kind) in zip((sums, words), added))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(name for name, _, _ in added)])

    return bounded_batches(df).select(*kept, text).mapInArrow(run, schema)
