"""String functions shared by the operators. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandgraph.session import column

# The characters that Python's str.strip() removes and str.split() splits on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends as str.splitlines() sees them.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
IMAGE_MARK = "<image>"
RELATION_SEPARATOR = " suggestive of "


def strip(c: Column | str) -> Column:
    return F.btrim(column(c), F.lit(WHITESPACE))


def lstrip(c: Column | str, chars: str = WHITESPACE) -> Column:
    return F.ltrim(column(c), F.lit(chars))


def rstrip(c: Column | str, chars: str = WHITESPACE) -> Column:
    return F.rtrim(column(c), F.lit(chars))


def words(c: Column | str) -> Column:
    """Whitespace tokens; an empty or blank text has none."""
    # A split on one plain character needs no pattern, which would be compiled for every row.
    spaced = F.translate(column(c), WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """Every run of whitespace becomes one space and the ends are trimmed."""
    return F.array_join(words(c), " ")


def lines(c: Column | str) -> Column:
    return F.split(column(c), LINE_END)


def is_blank(c: Column | str) -> Column:
    """True for null and for the empty string (both count as missing)."""
    return F.coalesce(column(c) == "", F.lit(True))


def starts_with(c: Column, prefix: str) -> Column:
    return c.startswith(F.lit(prefix))


def concat(*parts: Column | str) -> Column:
    """Concatenate columns and plain Python strings (a string here is a literal)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def dedupe_by(items: Column, key) -> Column:
    """Keep the first element for every value of ``key(element)``."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def text_blocks(c: Column | str, is_array: bool) -> Column:
    """A nullable text or array of texts as an array of trimmed, non-empty texts."""
    c = column(c)
    items = c if is_array else F.when(c.isNotNull(), F.array(c))
    trimmed = F.transform(items, strip)
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


# --- relation triplets -------------------------------------------------------


def parse_triplet(c: Column | str) -> Column:
    """STRUCT<subj, rel, obj>, split at the first separator; rel is null without one."""
    c = column(c)
    at = F.instr(c, RELATION_SEPARATOR)
    found = at > 0
    return F.struct(
        F.when(found, strip(F.substring(c, F.lit(1), at - 1))).otherwise(c).alias("subj"),
        F.when(found, F.lit("suggestive_of")).alias("rel"),
        F.when(found, strip(F.substring(c, at + len(RELATION_SEPARATOR), F.length(c)))).alias("obj"),
    )


def entities_strict(c: Column | str) -> Column:
    """Lowered, trimmed ends of a text with exactly one separator, else an empty array."""
    parts = F.split(column(c), RELATION_SEPARATOR)
    ends = F.transform(parts, lambda p: strip(F.lower(p)))
    return F.when(F.size(parts) == 2, ends).otherwise(F.array().cast("array<string>"))


def entities_loose(c: Column | str) -> Column:
    """Both ends at the first separator, or the whole lowered text as one entity."""
    text = F.lower(strip(c))
    parts = F.transform(F.split(text, RELATION_SEPARATOR, 2), strip)
    return F.when(F.size(parts) == 2, F.array_distinct(parts)).otherwise(F.array(text))


# --- identifiers and paths ---------------------------------------------------


def report_path(patient: Column | str, report: Column | str) -> Column:
    """``pNN/pPATIENT/sREPORT.txt``; null when an id is missing or the patient is too short."""
    patient, report = column(patient), column(report)
    p = F.when(starts_with(patient, "p"), patient).otherwise(concat("p", patient))
    s = F.when(starts_with(report, "s"), report).otherwise(concat("s", report))
    usable = ~is_blank(patient) & ~is_blank(report) & (F.length(p) >= 3)
    return F.when(usable, concat("p", F.substring(p, 2, 2), "/", p, "/", s, ".txt"))


def model_name_from_path(c: Column | str) -> Column:
    """Last path piece, or the last two joined by ``_`` for a checkpoint folder."""
    parts = F.split(F.btrim(column(c), F.lit("/")), "/")
    last = F.element_at(parts, -1)
    nested = starts_with(last, "checkpoint-") & (F.size(parts) >= 2)
    return F.when(nested, concat(F.try_element_at(parts, F.lit(-2)), "_", last)).otherwise(last)


# --- prompts -----------------------------------------------------------------


def strip_image_prefix(c: Column | str) -> Column:
    """Remove the image mark and newline, only at the very start."""
    c = column(c)
    prefix = IMAGE_MARK + "\n"
    return F.when(starts_with(c, prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def strip_image_anywhere(c: Column | str) -> Column:
    return strip(F.replace(column(c), F.lit(IMAGE_MARK), F.lit("")))


def extract_question(c: Column | str, marker: str = "And for the given image, ") -> Column:
    """The text after the first marker, else the whole prompt; trimmed."""
    c = column(c)
    at = F.instr(c, marker)
    return strip(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c))


def normalize_image_token(c: Column | str, wrap: tuple[str, str] | None = None, tag: tuple[str, str] | None = None) -> Column:
    """Move the image mark to its own first line; optionally tag and wrap it."""
    c = column(c)
    moved = strip(concat(IMAGE_MARK + "\n", strip_image_anywhere(c)))
    if tag:
        moved = F.replace(moved, F.lit(IMAGE_MARK), F.lit(tag[0] + IMAGE_MARK + tag[1]))
    out = F.when(c.contains(IMAGE_MARK), moved).otherwise(c)
    if wrap:
        out = F.replace(out, F.lit(IMAGE_MARK), F.lit(wrap[0] + IMAGE_MARK + wrap[1]))
    return out


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def ascii_tokens(c: Column | str) -> Column:
    """Lowered runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(column(c)), "[^a-z0-9]+"), lambda w: w != "")
