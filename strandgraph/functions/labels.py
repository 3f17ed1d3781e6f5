"""Label encodings: one-hot arrays, status triples and raw categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandgraph.session import column

# --- fixed values ------------------------------------------------------------

DIAGNOSES = [
    "Atelectasis",
    "Consolidation",
    "Edema",
    "Enlarged Cardiomediastinum",
    "Lung Lesion",
    "Lung Opacity",
    "Pleural Effusion",
    "Pleural Other",
    "Pneumonia",
    "Pneumothorax",
]
CERTAINTY = ["negative", "uncertain", "positive"]


def decode_labels(img_labels: Column | str, names: Sequence[str] = tuple(DIAGNOSES), levels: Sequence[str] = tuple(CERTAINTY)) -> Column:
    """``uncertain X, positive Y`` in class order; both levels of a class may be set."""
    known = F.array(*[F.lit(n) for n in names])
    per_class = F.transform(
        column(img_labels),
        lambda flags, i: F.filter(
            F.array(
                F.when(flags[1] != 0, F.concat(F.lit(levels[1] + " "), known[i])),
                F.when(flags[2] != 0, F.concat(F.lit(levels[2] + " "), known[i])),
            ),
            lambda s: s.isNotNull(),
        ),
    )
    return F.array_join(F.flatten(per_class), ", ")


def one_hot_name(label: Column | str, names: Sequence[str] = tuple(DIAGNOSES)) -> Column:
    """Name at the first 1, or ``None`` as text when there is none."""
    at = F.array_position(column(label), F.lit(1)).cast("int")
    return F.when(at > 0, F.try_element_at(F.array(*[F.lit(n) for n in names]), at)).otherwise("None")


def one_hot_status(triple: Column | str) -> Column:
    """Negative, Uncertain or Positive for an exact one-hot triple, else Invalid."""
    c = column(triple)

    def is_(*bits: int) -> Column:
        return c == F.array(*[F.lit(b) for b in bits])

    return F.when(is_(1, 0, 0), "Negative").when(is_(0, 1, 0), "Uncertain").when(is_(0, 0, 1), "Positive").otherwise("Invalid")


def encode_category(raw: Column | str) -> Column:
    """nan or 0.0 -> [1,0,0], -1.0 -> [0,1,0], 1.0 -> [0,0,1]; anything else is null."""
    c = column(raw)

    def bits(*b: int) -> Column:
        return F.array(*[F.lit(x) for x in b])

    return F.when(c.isin("nan", "0.0"), bits(1, 0, 0)).when(c == "-1.0", bits(0, 1, 0)).when(c == "1.0", bits(0, 0, 1))


def status_from_scores(negative: Column | str, uncertain: Column | str, positive: Column | str) -> Column:
    """positive above 0.5, else uncertain above 0.3, else negative."""
    return F.when(column(positive) > 0.5, "positive").when(column(uncertain) > 0.3, "uncertain").otherwise("negative")
