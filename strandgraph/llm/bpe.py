"""Exact byte-pair encoding with SentencePiece models, by backtracking, and decoding.

Greedy longest pieces are taken from the left. Two pieces may stand side by side
only if merging their joined characters again, best score first, gives back the
two: a sequence all of whose neighbours agree is the one that the merges make of
the whole text. Where scores fall from merge to merge, as in trained models, that is
read off the merges of either piece alone. Where no shorter piece agrees either, the position has failed,
which is noted in a bitfield, and the last piece is taken back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandgraph.llm.common import bounded_batches, give_back
from strandgraph.llm.pieces import SPACE, Pieces

#: Encoded segments in each of the two generations that a task keeps, compared pairs, and the longest segment kept.
KEPT, KEPT_PAIRS, KEPT_LENGTH = 200_000, 300_000, 48
#: Texts whose ids are held at a time.
ROWS = 256
#: The score of two parts that are no piece together.
NONE = float("-inf")


#: Whether the scores of a piece's merges fall, and its first and its last part: what each is, after the score that makes it longer.
Spine = tuple[bool, list[tuple[float, str]], list[tuple[float, str]]]


class Encoder:
    """Encodes segments of texts and keeps what it has seen; for one task.

    Inside, pieces go by codes: 0 stands for the start of a segment, the pieces
    follow in their order, and characters without a piece get the next codes when
    they are first met.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.names = ["", *pieces.ids]
        self.known, self.reach = len(self.names), pieces.longest
        self.sizes = [len(name) for name in self.names]
        self.numbers = ["", *map(str, pieces.ids.values())]
        self.texts = [name.replace(SPACE, " ") for name in self.names]
        self.code = {name: code for code, name in enumerate(self.names)}
        self.follow: list[dict[int, int]] = [{} for _ in self.names]
        self.shorter = [0] * self.known
        for code in range(1, self.known):
            self.shorter[code] = self._shorter(self.names[code])
        self.automaton = ahocorasick.Automaton()
        for name, code in self.code.items():
            if name:
                self.automaton.add_word(name, code)
        self.automaton.make_automaton()
        self.followed = 0
        self.spines: dict[int, Spine | None] = {}
        self.seen: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.changed: dict[str, str] = {}

    def merge(self, text: str, steps: list[tuple[float, int, list[str]]] | None = None) -> list[str]:
        """Merge neighbours into the piece of the best score, the leftmost of equals first, until none can be.

        ``steps`` takes the score and place of every merge and the parts after it.
        """
        parts, score = list(text), self.pieces.scores.get
        gains = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == NONE:
                break
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]  # only the sums with both neighbours of the new part change
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], NONE)
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], NONE)
            if steps is not None:
                steps.append((best, at, list(parts)))
        return parts

    def spine(self, code: int) -> Spine | None:
        """How the first and the last part of a piece grow while it is merged; None if its characters do not make it."""
        if code not in self.spines:
            name, steps = self.names[code], []
            made = self.merge(name, steps) == [name]
            scores = [score for score, _, _ in steps]
            first, last = [(NONE, name[0])], [(NONE, name[-1])]  # what the part is, and the score that makes it longer
            for score, at, parts in steps:
                if at == 0:
                    first[-1:] = [(score, first[-1][1]), (NONE, parts[0])]
                if at == len(parts) - 1:
                    last[-1:] = [(score, last[-1][1]), (NONE, parts[-1])]
            falling = all(a > b for a, b in zip(scores, scores[1:]))
            self.spines[code] = (falling, first, last) if made else None
        return self.spines[code]

    def agree(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` may follow ``left`` (or start a segment, if left is 0).

        It may if both are made of their characters before any merge across their
        border is due. While scores fall from merge to merge, a merge across is due
        when its score is above those that next change the parts at the border;
        where scores do not fall, or are equal, the two are merged again.
        """
        behind = self.spine(right)
        if not left or behind is None:
            return behind is not None
        before = self.spine(left)
        if before is None:
            return False
        if before[0] and behind[0]:
            lasts, firsts, score = before[2], behind[1], self.pieces.scores.get
            i = j = 0
            while True:
                (next_left, a), (next_right, b) = lasts[i], firsts[j]
                across, ahead = score(a + b, NONE), max(next_left, next_right)
                if across > ahead:
                    return False
                if ahead == NONE:
                    return True
                if across == ahead or next_left == next_right:
                    break
                if next_left > next_right:
                    i += 1
                else:
                    j += 1
        names = [self.names[left], self.names[right]]
        return self.merge("".join(names)) == names

    def fitting(self, left: int, right: int) -> int:
        """The longest of ``right`` and its shorter pieces that may follow ``left``; 0 if none may."""
        passed, fit, known = [], right, self.follow[left]
        while fit and fit not in known:
            passed.append(fit)
            if self.agree(left, fit):
                break
            fit = self.shorter[fit]
        fit = known.get(fit, fit)
        self.followed += len(passed)
        if self.followed > KEPT_PAIRS:
            for kept in self.follow:
                kept.clear()
            self.followed = len(passed)
        known.update(dict.fromkeys(passed, fit))
        return fit

    def _shorter(self, name: str) -> int:
        """Code of the next shorter piece (or single character) that a piece begins with; 0 for a character."""
        for size in range(len(name) - 1, 0, -1):
            code = self.code.get(name[:size]) if size > 1 else self._character(name[0])
            if code is not None:
                return code
        return 0

    def _character(self, char: str) -> int:
        """Code of a character, which is new if it has no piece."""
        code = self.code.get(char)
        if code is None:
            code = self.code[char] = len(self.names)
            self.names.append(char)
            self.sizes.append(1)
            self.shorter.append(0)
            self.follow.append({})
        return code

    def longest(self, segment: str, at: int) -> int:
        """Code of the longest piece that the rest of a segment begins with; of the character, if none does."""
        for end, code in self.automaton.iter_long(segment, at, min(len(segment), at + self.reach)):
            if end + 1 - self.sizes[code] == at:
                return code
            break
        return self._character(segment[at])

    def split(self, segment: str) -> list[int]:
        """Codes of the pieces of a segment; characters without a piece stand alone."""
        n, sizes = len(segment), self.sizes
        failed = None  # the bitfield, once a position has failed
        out: list[int] = []
        at, last, code = 0, 0, self.longest(segment, 0)
        follow, shorter = self.follow, self.shorter
        while True:
            fit = follow[last].get(code)
            if fit is None:
                fit = self.fitting(last, code)
            if fit:
                end = at + sizes[fit]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    out.append(fit)
                    if end == n:
                        return out
                    at, last, code = end, fit, self.longest(segment, end)
                    continue
                code = shorter[fit]
            else:
                code = 0
            if not code:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                code = out.pop()
                at -= sizes[code]
                last = out[-1] if out else 0
                code = shorter[code]
                while not code:  # a character was taken back: its place has failed too
                    failed[at >> 3] |= 1 << (at & 7)
                    code = out.pop()
                    at -= sizes[code]
                    last = out[-1] if out else 0
                    code = shorter[code]

    def ids(self, segment: str) -> list[int]:
        """Ids of a segment: unknown characters become their bytes, or the unknown id without byte pieces."""
        known, fallback, out = self.pieces.ids, self.pieces.bytes_, []
        for piece in (self.names[code] for code in self.split(segment)):
            if piece in known:
                out.append(known[piece])
            elif fallback:
                out.extend(fallback[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.pieces.unknown)
        return out

    def entry(self, segment: str) -> str:
        """Ids as text of a segment whose spaces are plain ones. If it decodes to another text, that is in ``changed``."""
        got = self.seen.get(segment)
        if got is None:
            got = self.before.get(segment)
            if got is not None:
                self._keep(segment, got)
        if got is None:
            marked = segment.replace(" ", SPACE)
            codes = self.split(marked)
            if max(codes) < self.known:
                numbers, texts = self.numbers, self.texts
                got, back = ",".join([numbers[c] for c in codes]), "".join([texts[c] for c in codes])
            else:
                ids = self.ids(marked)
                got, back = ",".join(map(str, ids)), decode(ids, self.pieces, first=False)
            if back != segment:
                self.changed[segment] = back
            elif len(segment) <= KEPT_LENGTH:
                self._keep(segment, got)
        return got

    def _keep(self, segment: str, entry: str) -> None:
        """A full generation takes the place of the one before it; what is met again moves to the new one."""
        if len(self.seen) >= KEPT:
            self.seen, self.before = {}, self.seen
        self.seen[segment] = entry

    def forget(self) -> None:
        """Drop the segments; the compared pairs stay."""
        self.seen, self.before, self.changed = {}, {}, {}

    def encode(self, text: str) -> list[int]:
        return [i for segment in self.pieces.segments(text) for i in self.ids(segment)]


def decode(ids: list[int], pieces: Pieces, first: bool = True) -> str:
    """Text of ids. ``first``: the ids begin a text, so the space put in front of it is taken off."""
    place = {i: b for b, i in enumerate(pieces.bytes_)}
    out, raw = [], bytearray()
    for i in ids:
        if i in place:
            raw.append(place[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(" ⁇ " if i == pieces.unknown else pieces.surfaces[i].replace(SPACE, " "))
    out.append(raw.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:] if first and ids and pieces.surfaces[ids[0]].startswith(SPACE) else text


#: The encoder of this worker, by the model it was made from; workers are used for many tasks.
_ENCODERS: dict[int, Encoder] = {}


def with_tokens(df: DataFrame, text: str, pieces: Pieces, decoded: bool = False, ids: bool = False) -> DataFrame:
    """Replace the text column by n_tokens, ids_sha256 and decoded_sha256.

    With ``ids`` and ``decoded`` the ids and the decoded text themselves follow as
    columns token_ids and decoded_text. Null texts are empty texts: no ids.
    """
    kept = [c for c in df.columns if c != text]
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    if ids:
        added.append(("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    if decoded:
        added.append(("decoded_text", T.StringType(), pa.string()))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in added])
    model = hash(frozenset(pieces.ids.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[model] = Encoder(pieces)
        encoder = _ENCODERS[model]
        miss = encoder.entry
        for batch in (part.slice(at, ROWS) for part in batches for at in range(0, part.num_rows, ROWS)):
            results: list[list] = [[] for _ in added]
            for value in batch.column(text):
                seen = encoder.seen.get  # a generation may have ended
                segments = pieces.segments(value.as_py() or "", " ")
                listed = ",".join([seen(s) or miss(s) for s in segments])
                if encoder.changed:
                    segments = [encoder.changed.get(s, s) for s in segments]
                    encoder.changed.clear()
                back = "".join(segments)[1:]  # every text begins with the space put in front
                row = [listed.count(",") + 1 if listed else 0, _sha(listed), _sha(back)]
                if ids:
                    row.append(np.array(listed.split(",") if listed else [], dtype=np.int32))
                if decoded:
                    row.append(back)
                for result, item in zip(results, row):
                    result.append(item)
            columns = [pa.array(result, kind) for result, (_, _, kind) in zip(results, added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *(name for name, _, _ in added)])
        encoder.forget()  # the worker may go on with other work; only the compared pairs are kept for its next task
        give_back()

    return bounded_batches(df).select(*kept, text).mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
