"""Free-text reports: sections, sentences and one text per report.

Section work happens inside the row with array functions, so a report never
leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators.ordinal import latest_by

# --- fixed values ------------------------------------------------------------

SECTION_HEADER = r"\n ([A-Z ()/,-]+):" + "[" + t.WHITESPACE + "]"
LINE_HEADER = "[A-Za-z][A-Za-z /_-]{1,40}:"

SECTION_ALIASES = {
    "preamble": "preamble",
    "impression": "impression",
    "comparison": "comparison",
    "indication": "indication",
    "findings": "findings",
    "examination": "examination",
    "technique": "technique",
    "history": "history",
    "comparisons": "comparison",
    "clinical history": "history",
    "reason for examination": "indication",
    "notification": "notification",
    "reason for exam": "indication",
    "clinical information": "history",
    "exam": "examination",
    "clinical indication": "indication",
    "conclusion": "impression",
    "chest, two views": "findings",
    "recommendation(s)": "recommendations",
    "type of examination": "examination",
    "reference exam": "comparison",
    "patient history": "history",
    "addendum": "addendum",
    "comparison exam": "comparison",
    "date": "date",
    "comment": "comment",
    "findings and impression": "impression",
    "wet read": "wet read",
    "comparison film": "comparison",
    "recommendations": "recommendations",
    "findings/impression": "impression",
    "pfi": "history",
    "recommendation": "recommendations",
    "wetread": "wet read",
    "ndication": "impression",
    "impresson": "impression",
    "imprression": "impression",
    "imoression": "impression",
    "impressoin": "impression",
    "imprssion": "impression",
    "impresion": "impression",
    "imperssion": "impression",
    "mpression": "impression",
    "impession": "impression",
    "findings/ impression": "impression",
    "finding": "findings",
    "findins": "findings",
    "findindgs": "findings",
    "findgings": "findings",
    "findngs": "findings",
    "findnings": "findings",
    "finidngs": "findings",
    "idication": "indication",
    "reference findings": "findings",
    "comparision": "comparison",
    "comparsion": "comparison",
    "comparrison": "comparison",
    "comparisions": "comparison",
}
CONTAINED_SECTIONS = ["impression", "findings", "history", "comparison", "addendum"]
STUDY_DESCRIPTIONS = [
    "chest",
    "portable",
    "pa and lateral",
    "lateral and pa",
    "ap and lateral",
    "lateral and ap",
    "frontal and",
    "two views",
    "frontal view",
    "pa view",
    "ap view",
    "one view",
    "lateral view",
    "bone window",
    "frontal upright",
    "frontal semi-upright",
    "ribs",
    "pa and lat",
]
KEPT_SECTIONS = ["impression", "findings"]
PARAGRAPH_BREAK = "\n \n"

# --- sections ----------------------------------------------------------------


def raw_sections(text: Column | str) -> Column:
    """ARRAY<STRUCT<name, text>> in report order, names lowered but not normalised."""
    c = F.col(text) if isinstance(text, str) else text
    headers = F.regexp_extract_all(c, F.lit(SECTION_HEADER), F.lit(1))
    parts = F.split(c, SECTION_HEADER, -1)
    names = F.concat(F.array(F.lit("preamble")), F.transform(headers, F.lower))
    # The preamble runs up to the first header's name, past its newline and space.
    bodies = F.transform(parts, lambda body, i: F.when(i == 0, F.concat(body, F.lit("\n "))).otherwise(body))
    found = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("text")))
    whole = F.array(F.struct(F.lit("full report").alias("name"), c.alias("text")))
    return F.when(F.size(headers) > 0, found).otherwise(whole)


def normalize_section_name(name: Column | str) -> Column:
    """Alias table, then a contained main section, then a study description, else as is."""
    n = t.strip(F.lower(F.col(name) if isinstance(name, str) else name))
    aliases = F.create_map(*[F.lit(x) for pair in SECTION_ALIASES.items() for x in pair])
    contained = F.coalesce(*[F.when(n.contains(m), F.lit(m)) for m in CONTAINED_SECTIONS])
    described = F.when(n.rlike("|".join(STUDY_DESCRIPTIONS)), F.lit("findings"))
    return F.coalesce(F.try_element_at(aliases, n), contained, described, n)


def with_sections(reports: DataFrame) -> DataFrame:
    """Add ``sections``: names normalised, blank main sections dropped, a last paragraph split off if none remain.

    Each step is a column of its own, so it is evaluated once per report.
    """
    named = F.transform("_raw", lambda s: F.struct(normalize_section_name(s["name"]).alias("name"), s["text"].alias("text")))
    kept = F.filter("_named", lambda s: ~(s["name"].isin(KEPT_SECTIONS) & (t.strip(s["text"]) == "")))
    has_main = F.exists("_kept", lambda s: s["name"].isin(KEPT_SECTIONS))
    last = F.element_at("_kept", -1)
    pieces = F.when(~has_main & last["text"].contains(PARAGRAPH_BREAK), F.split(last["text"], PARAGRAPH_BREAK))
    head = F.struct(last["name"].alias("name"), F.element_at("_pieces", 1).alias("text"))
    tail = F.struct(
        F.lit("last_paragraph").alias("name"),
        F.array_join(F.slice("_pieces", F.lit(2), F.size("_pieces")), PARAGRAPH_BREAK).alias("text"),
    )
    with_tail = F.concat(F.slice("_kept", F.lit(1), F.size("_kept") - 1), F.array(head, tail))
    return (
        reports.withColumn("_raw", raw_sections("text"))
        .withColumn("_named", named)
        .withColumn("_kept", kept)
        .withColumn("_pieces", F.when(F.size("_kept") > 0, pieces))
        .withColumn("sections", F.when(F.col("_pieces").isNotNull(), with_tail).otherwise(F.col("_kept")))
        .drop("_raw", "_named", "_kept", "_pieces")
    )


def split_sections(reports: DataFrame) -> DataFrame:
    """reports(patient_id, report_id, text) -> patient_id, report_id, pos, name, text."""
    return (
        with_sections(reports)
        .select("patient_id", "report_id", F.posexplode("sections").alias("pos", "_s"))
        .select("patient_id", "report_id", "pos", F.col("_s.name").alias("name"), F.col("_s.text").alias("text"))
    )


def main_text(sections: Column) -> Column:
    """Findings and impression joined without newlines; null when neither is present."""
    kept = F.filter(sections, lambda s: s["name"].isin(KEPT_SECTIONS))
    joined = F.array_join(F.transform(kept, lambda s: F.replace(s["text"], F.lit("\n"), F.lit(""))), "")
    return F.when(F.size(kept) > 0, F.replace(joined, F.lit("  "), F.lit(" ")))


def sentences(text: Column) -> Column:
    """Split after . ! or ? and whitespace when a capital follows; trimmed, non-empty."""
    space = "[" + t.WHITESPACE + "]"
    parts = F.split(text, f"(?<=[.!?]){space}+(?=[A-Z])")
    return F.filter(F.transform(parts, t.strip), lambda s: s != "")


def split_sentences(reports: DataFrame) -> DataFrame:
    """reports(patient_id, report_id, text) -> sentence_id, patient_id, report_id, sentence."""
    parsed = with_sections(reports).select("patient_id", "report_id", main_text(F.col("sections")).alias("_text"))
    return (
        parsed.where(F.col("_text").isNotNull())
        .select("patient_id", "report_id", F.posexplode(sentences(F.col("_text"))).alias("_i", "sentence"))
        .select(
            F.concat_ws("#", "report_id", F.col("_i").cast("string")).alias("sentence_id"),
            "patient_id",
            "report_id",
            "sentence",
        )
    )


def findings_impression(reports: DataFrame) -> DataFrame:
    """report_id, text: findings sections, then impression sections, else the whole report.

    This is the line-based parser: a header is a short label and a colon at the
    start of a line; repeated headers extend their first section.
    """
    kept = F.filter(F.transform(t.lines("text"), t.strip), lambda line: line != "")
    body = F.array_join(kept, "\n")
    # (?md): ^ matches after \n only.
    header = f"(?md)^({LINE_HEADER[:-1]}):[^\\S\\n]*"
    parsed = reports.withColumn("_body", body).withColumn(
        "_names", F.transform(F.regexp_extract_all("_body", F.lit(header), F.lit(1)), lambda n: F.lower(t.strip(n)))
    )
    parsed = parsed.withColumn("_parts", F.slice(F.split("_body", header, -1), F.lit(2), F.size("_names")))
    flat = F.transform("_parts", lambda p: t.strip(F.replace(p, F.lit("\n"), F.lit(" "))))
    pairs = F.arrays_zip(F.col("_names").alias("name"), flat.alias("text"))
    picked = F.concat(*[_sections_starting(F.col("_pairs"), wanted) for wanted in ("findings", "impression")])
    parsed = parsed.withColumn("_pairs", F.filter(pairs, lambda p: p["text"] != ""))
    parsed = parsed.withColumn("_picked", picked)
    return parsed.select(
        "report_id",
        F.when(F.size("_picked") > 0, F.array_join("_picked", " ")).otherwise(t.squeeze("text")).alias("text"),
    )


def _sections_starting(pairs: Column, wanted: str) -> Column:
    mine = F.filter(pairs, lambda p: p["name"].startswith(wanted))
    names = F.array_distinct(F.transform(mine, lambda p: p["name"]))
    return F.transform(
        names,
        lambda n: F.array_join(F.transform(F.filter(mine, lambda p: p["name"] == n), lambda p: p["text"]), " "),
    )


# --- joins over reports ------------------------------------------------------


def assign_sentences(query: DataFrame, sentence_table: DataFrame, order: Column | str | None = None) -> DataFrame:
    """Inner join on sentence_id; of repeated sentence ids the last under ``order`` wins."""
    unique = sentence_table
    if order is not None:
        unique = latest_by(sentence_table, ["sentence_id"], order)
        if isinstance(order, str):
            unique = unique.drop(order)
    return query.join(unique.withColumnRenamed("sentence", "nle"), "sentence_id")


def report_key(report: Column | str, sentence: Column | str) -> Column:
    """The report id, or the sentence id when the report id is null or empty."""
    report = F.col(report) if isinstance(report, str) else report
    sentence = F.col(sentence) if isinstance(sentence, str) else sentence
    return F.when(t.is_blank(report), sentence).otherwise(report)


def report_text(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """rows(report_id, sentence_id, nle, ord) -> report_id, text, source.

    The non-blank explanations of a report in ``ord`` order. With ``reports``
    (report_id, text), the report's text is put in front where there is one.
    """
    nle = t.strip(F.coalesce(F.col("nle"), F.lit("")))
    keyed = rows.select(report_key("report_id", "sentence_id").alias("report_id"), "ord", nle.alias("nle"))
    # Blank rows are dropped inside the aggregate so that their report is kept.
    entry = F.when(F.col("nle") != "", F.struct("ord", "nle"))
    merged = keyed.groupBy("report_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["nle"]), " ").alias("_nle")
    )
    if reports is None:
        return merged.select("report_id", F.col("_nle").alias("text"), F.lit("nle").alias("source"))
    texts = reports.select("report_id", F.col("text").alias("_report"))
    found = F.col("_report").isNotNull()
    both = F.when(F.col("_nle") == "", F.col("_report")).otherwise(F.concat_ws(" ", "_report", "_nle"))
    return merged.join(texts, "report_id", "left").select(
        "report_id",
        F.when(found, both).otherwise(F.col("_nle")).alias("text"),
        F.when(found, "report").otherwise("nle").alias("source"),
    )
