"""SentencePiece models with identity normalisation: what is in the file, and where texts may be cut."""

from __future__ import annotations

import re
from dataclasses import dataclass

SPACE = "▁"
#: Piece types of the model file format: fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Pieces:
    """Ids and scores of ordinary pieces, ids of byte pieces (empty without byte fallback), the unknown id and all surfaces."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: tuple[int, ...]
    unknown: int
    surfaces: tuple[str, ...]
    longest: int
    cut: str

    def segments(self, text: str, mark: str = SPACE) -> list[str]:
        """Parts of a text, spaces marked and one put in front, that no piece crosses; none for the empty text."""
        if not text:
            return []
        other = " " if mark == SPACE else SPACE
        return re.findall(self.cut.replace(SPACE, mark), mark + text.replace(other, mark))


def load(path: str) -> Pieces:
    """Read a model file on the driver.

    Models that rewrite characters, drop spaces, have pieces of other types (user
    defined, unused) or pieces with a space behind a letter are refused: for them
    texts cannot be cut at spaces.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("the model normalises texts")
    if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("the model has user-defined or unused pieces")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if any(SPACE in piece.lstrip(SPACE) for piece in ids):
        raise ValueError("a piece has a space behind a letter")
    alone = not any("\n" in piece for piece in ids)
    return Pieces(
        ids=ids,
        scores={p.piece: p.score for p in model.pieces if p.type == NORMAL},
        bytes_=tuple(i for i, p in enumerate(model.pieces) if p.type == BYTE),
        unknown=next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN),
        surfaces=tuple(p.piece if p.type == NORMAL else "" for p in model.pieces),
        longest=max(map(len, ids), default=1),
        cut=rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+",
    )
