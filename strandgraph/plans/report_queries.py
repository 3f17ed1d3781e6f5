"""Registered queries: reports and triplets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import text as t
from strandgraph.operators import reports as R
from strandgraph.operators import triplets as T
from strandgraph.plans import fixtures as fx
from strandgraph.plans.fixtures import add_view, with_views

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def report_sections(spark, d):
    return R.split_sections(fx.reports(spark, d)).select("report_id", F.col("pos").cast("long").alias("pos"), "name", "text")


def report_sentences(spark, d):
    return R.split_sentences(fx.reports(spark, d))


def findings_impression(spark, d):
    return R.findings_impression(fx.reports(spark, d))


def report_paths(spark, d):
    return fx.rows_nle(spark, d).select(
        "sentence_id", "ord", t.report_path(F.expr("substring(patient_id, 2)"), "report_id").alias("path")
    )


def triplet_parse(spark, d):
    p = t.parse_triplet("triplet")
    return fx.rows_nle(spark, d).select(
        "sentence_id",
        "ord",
        p["subj"].alias("subj"),
        p["rel"].alias("rel"),
        p["obj"].alias("obj"),
        F.array_join(t.entities_strict("triplet"), "|").alias("strict"),
        F.array_join(t.entities_loose("triplet"), "|").alias("loose"),
    )


def _sentence_table(spark, d):
    return fx.rows_nle(spark, d).select("sentence_id", F.col("study_id").alias("report_id"), "patient_id", F.col("nle").alias("sentence"), "ord")


def assign_sentences(spark, d):
    # Lines 1 to 8 of every order; no order has eight, so some ids match nothing.
    lines = fx.table(spark, d, "orders").withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(8))))
    ends = lines.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string"), F.lit("#"), F.col("line").cast("string")).alias("sentence_id"),
        F.col("o_orderpriority").alias("diagnosis"),
    )
    return R.assign_sentences(ends, _sentence_table(spark, d), "ord").select(
        "sentence_id", "diagnosis", "nle", "report_id", "patient_id"
    )


def report_text(spark, d):
    texts = fx.table(spark, d, "documents").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("report_id"), "text"
    )
    return R.report_text(fx.rows_nle(spark, d), texts)


def _annotations(spark, d):
    """Two relations per order line in one annotation array per order; some lists are null."""
    rows = fx.rows_nle(spark, d)
    listed = F.when(F.col("triplet").contains(" suggestive of "), F.array(F.col("triplet"), F.lower("triplet")))
    grouped = rows.select("study_id", F.struct("ord", listed.alias("suggestive_of")).alias("e")).groupBy("study_id")
    return grouped.agg(F.array_sort(F.collect_list("e")).alias("a")).select(
        F.col("study_id").alias("report_id"),
        F.transform("a", lambda e: F.struct(e["suggestive_of"].alias("suggestive_of"))).alias("processed_annotations"),
    )


def report_triplets(spark, d):
    return T.report_triplets(_annotations(spark, d)).select(
        "report_id", F.array_join("triplets", "|").alias("triplets"), F.size("triplets").cast("long").alias("n")
    )


def attach_triplets(spark, d):
    rows = fx.rows_nle(spark, d).select("sentence_id", "report_id", "ord")
    out = T.attach_triplets(rows, T.report_triplets(_annotations(spark, d)))
    return out.select("sentence_id", "report_id", "ord", F.array_join("triplets", "|").alias("triplets"))


def triplet_stats(spark, d):
    return T.triplet_stats(T.report_triplets(_annotations(spark, d)))


def vocabulary(spark, d):
    return T.vocabulary(fx.rows_nle(spark, d).select(F.array("triplet").alias("triplets")))


def union_splits(spark, d):
    """Rows of all splits are merged per report once, then counted per split again."""
    rows = fx.rows_nle(spark, d)
    parts = [
        rows.where(F.col("l_linenumber") <= 3).withColumn("split", F.lit("train")),
        rows.where(F.col("l_linenumber") > 3).withColumn("split", F.lit("val")),
    ]
    every = parts[0].unionByName(parts[1]).withColumn("triplets", F.array("triplet"))
    merged = T.merge_in_order(every.withColumn("key", R.report_key("report_id", "sentence_id")), ["key"], "triplets", "ord", "merged")
    back = every.select("split", R.report_key("report_id", "sentence_id").alias("key")).distinct()
    return (
        back.join(merged, "key")
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("reports"), F.sum(F.size("merged")).alias("triplets"))
    )


def triplet_text_tokens(spark, d):
    return T.max_tokens(fx.table(spark, d, "documents"), "text", 100).select("doc_id", t.word_count("text").cast("long").alias("n_tokens"))


QUERIES = {
    "report_sections": report_sections,
    "report_sentences": report_sentences,
    "findings_impression": findings_impression,
    "report_paths": report_paths,
    "triplet_parse": triplet_parse,
    "assign_sentences": assign_sentences,
    "report_text": report_text,
    "report_triplets": report_triplets,
    "attach_triplets": attach_triplets,
    "triplet_stats": triplet_stats,
    "vocabulary": vocabulary,
    "union_splits": union_splits,
    "max_tokens": triplet_text_tokens,
}

# --- oracles -----------------------------------------------------------------

_ALIAS = ", ".join(f"'{k}': '{v}'" for k, v in R.SECTION_ALIASES.items())
_DESCRIBED = "|".join(R.STUDY_DESCRIPTIONS)
_HEADER = r"\n ([A-Z ()/,-]+):\s"

# One row per raw section: names from the matches, bodies from the pieces between them.
add_view(
    "sec_raw",
    f"""
    SELECT report_id, patient_id, pos, CASE WHEN pos = 1 AND n = 0 THEN 'full report' WHEN pos = 1 THEN 'preamble' ELSE lower(names[pos - 1]) END AS raw,
           CASE WHEN pos = 1 AND n > 0 THEN parts[1] || E'\\n ' ELSE parts[pos] END AS text
    FROM (SELECT *, len(names) AS n, unnest(range(1, len(parts) + 1)) AS pos
          FROM (SELECT report_id, patient_id, regexp_extract_all(text, '{_HEADER}', 1) AS names,
                       string_split(regexp_replace(text, '{_HEADER}', chr(1), 'g'), chr(1)) AS parts FROM fx_reports))""",
    ["fx_reports"],
)
add_view(
    "sec_named",
    f"""
    SELECT report_id, patient_id, pos, text, CASE
        WHEN map_contains(al, key) THEN al[key]
        WHEN contains(key, 'impression') THEN 'impression' WHEN contains(key, 'findings') THEN 'findings'
        WHEN contains(key, 'history') THEN 'history' WHEN contains(key, 'comparison') THEN 'comparison'
        WHEN contains(key, 'addendum') THEN 'addendum'
        WHEN regexp_matches(key, '{_DESCRIBED}') THEN 'findings' ELSE key END AS name
    FROM (SELECT *, trim(lower(raw), {WS}) AS key, MAP {{{_ALIAS}}} AS al FROM sec_raw)""",
    ["sec_raw"],
)
add_view(
    "sec_kept",
    f"""
    SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY report_id) AS total,
           max(CASE WHEN name IN ('impression', 'findings') THEN 1 ELSE 0 END) OVER (PARTITION BY report_id) AS has_main
    FROM sec_named WHERE NOT (name IN ('impression', 'findings') AND trim(text, {WS}) = '')""",
    ["sec_named"],
)
add_view(
    "sections",
    """
    SELECT patient_id, report_id, i AS pos, name,
           CASE WHEN cut > 0 THEN substr(text, 1, cut - 1) ELSE text END AS text
    FROM (SELECT *, CASE WHEN has_main = 0 AND i = total - 1 THEN instr(text, E'\\n \\n') ELSE 0 END AS cut FROM sec_kept)
    UNION ALL
    SELECT patient_id, report_id, i + 1, 'last_paragraph', substr(text, instr(text, E'\\n \\n') + 3)
    FROM sec_kept WHERE has_main = 0 AND i = total - 1 AND instr(text, E'\\n \\n') > 0""",
    ["sec_kept"],
)

add_view(
    "fx_annotations",
    """
    SELECT study_id AS report_id, ord, k, CASE WHEN k = 1 THEN triplet ELSE lower(triplet) END AS triplet,
           contains(triplet, ' suggestive of ') AS listed
    FROM fx_nle, (SELECT unnest([1, 2]) AS k)""",
    ["fx_nle"],
)
add_view(
    "report_trip",
    """
    SELECT r.report_id, coalesce(string_agg(triplet, '|' ORDER BY ord, k), '') AS triplets, count(triplet) AS n
    FROM (SELECT DISTINCT report_id FROM fx_annotations) r LEFT JOIN
         (SELECT report_id, triplet, ord, k, row_number() OVER (PARTITION BY report_id, triplet ORDER BY ord, k) AS rn
          FROM fx_annotations WHERE listed) t ON r.report_id = t.report_id AND rn = 1
    GROUP BY r.report_id""",
    ["fx_annotations"],
)
_KEY = "CASE WHEN report_id IS NULL OR report_id = '' THEN sentence_id ELSE report_id END"

ORACLE = {
    "report_sections": with_views("SELECT report_id, pos, name, text FROM sections", "sections"),
    "report_sentences": with_views(
        rf"""
        WITH joined AS (
            SELECT patient_id, report_id, replace(string_agg(replace(text, chr(10), ''), '' ORDER BY pos), '  ', ' ') AS text
            FROM sections WHERE name IN ('impression', 'findings') GROUP BY ALL),
        pieces AS (
            SELECT patient_id, report_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i
            FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM joined))
        SELECT report_id || '#' || (row_number() OVER (PARTITION BY report_id ORDER BY i) - 1) AS sentence_id,
               patient_id, report_id, trim(piece, {WS}) AS sentence
        FROM pieces WHERE trim(piece, {WS}) <> ''""",
        "sections",
    ),
    # Lines, a filled-down header, first-occurrence order of the sections.
    "findings_impression": with_views(
        rf"""
        WITH ln AS (
            SELECT report_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
            FROM (SELECT report_id, string_split(regexp_replace(text, '\r\n|[\n\x0b\f\r]', chr(10), 'g'), chr(10)) AS ls FROM fx_reports)),
        st AS (SELECT report_id, i, trim(line, {WS}) AS line FROM ln WHERE trim(line, {WS}) <> ''),
        hd AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Za-z][A-Za-z /_-]{{1,40}}:') THEN
                        trim(lower(regexp_extract(line, '^([A-Za-z][A-Za-z /_-]{{1,40}}):', 1)), {WS}) END AS h FROM st),
        fl AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY i) AS sec,
                      CASE WHEN h IS NULL THEN line ELSE trim(regexp_replace(line, '^[A-Za-z][A-Za-z /_-]{{1,40}}:', ''), {WS}) END AS body FROM hd),
        sc AS (SELECT report_id, sec, min(i) AS pl, string_agg(body, ' ' ORDER BY i) AS text
               FROM fl WHERE body <> '' AND (starts_with(sec, 'findings') OR starts_with(sec, 'impression')) GROUP BY ALL),
        pk AS (SELECT report_id, string_agg(text, ' ' ORDER BY CASE WHEN starts_with(sec, 'findings') THEN 0 ELSE 1 END, pl) AS text FROM sc GROUP BY 1)
        SELECT r.report_id, coalesce(pk.text, trim(regexp_replace(r.text, '\s+', ' ', 'g'))) AS text
        FROM fx_reports r LEFT JOIN pk ON r.report_id = pk.report_id""",
        "fx_reports",
    ),
    "report_paths": with_views(
        """
        SELECT sentence_id, ord, CASE WHEN report_id <> '' THEN
               substr(patient_id, 1, 3) || '/' || patient_id || '/' || report_id || '.txt' END AS path FROM fx_nle""",
        "fx_nle",
    ),
    "triplet_parse": with_views(
        """
        SELECT sentence_id, ord,
               CASE WHEN pl > 0 THEN trim(substr(triplet, 1, pl - 1)) ELSE triplet END AS subj,
               CASE WHEN pl > 0 THEN 'suggestive_of' END AS rel,
               CASE WHEN pl > 0 THEN trim(substr(triplet, pl + 15)) END AS obj,
               CASE WHEN pl > 0 THEN replace(lower(triplet), ' suggestive of ', '|') ELSE '' END AS strict,
               replace(lower(triplet), ' suggestive of ', '|') AS loose
        FROM (SELECT *, instr(triplet, ' suggestive of ') AS pl FROM fx_nle)""",
        "fx_nle",
    ),
    "assign_sentences": with_views(
        """
        SELECT s.sentence_id, o_orderpriority AS diagnosis, nle, study_id AS report_id, patient_id
        FROM (SELECT *, unnest(range(1, 9)) AS line FROM orders) JOIN (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY ord DESC) AS rn FROM fx_nle) s
             ON s.sentence_id = 's' || o_orderkey || '#' || line AND rn = 1""",
        "fx_nle",
    ),
    "report_text": with_views(
        f"""
        WITH k AS (SELECT {_KEY} AS report_id, ord, trim(nle) AS nle FROM fx_nle),
        m AS (SELECT report_id, coalesce(string_agg(nle, ' ' ORDER BY ord) FILTER (WHERE nle <> ''), '') AS nle FROM k GROUP BY 1)
        SELECT m.report_id, CASE WHEN d.doc_id IS NULL THEN nle WHEN nle = '' THEN text ELSE text || ' ' || nle END AS text,
               CASE WHEN d.doc_id IS NULL THEN 'nle' ELSE 'report' END AS source
        FROM m LEFT JOIN documents d ON m.report_id = 's' || d.doc_id""",
        "fx_nle",
    ),
    "report_triplets": with_views("SELECT report_id, triplets, n FROM report_trip", "report_trip"),
    "attach_triplets": with_views(
        f"""
        SELECT sentence_id, n.report_id, ord, coalesce(t.triplets, '') AS triplets
        FROM fx_nle n LEFT JOIN report_trip t ON t.report_id = CASE WHEN n.report_id = '' THEN n.sentence_id ELSE n.report_id END""",
        "fx_nle",
        "report_trip",
    ),
    "triplet_stats": with_views(
        """
        SELECT count(*) AS reports, count(*) FILTER (WHERE n = 0) AS empty_reports,
               round(100.0 * count(*) FILTER (WHERE n = 0) / greatest(count(*), 1), 1) AS empty_report_pct FROM report_trip""",
        "report_trip",
    ),
    "vocabulary": with_views(
        """
        SELECT DISTINCT unnest(string_split(lower(triplet), ' suggestive of ')) AS entity
        FROM fx_nle WHERE contains(triplet, ' suggestive of ')""",
        "fx_nle",
    ),
    "union_splits": with_views(
        f"""
        WITH k AS (SELECT {_KEY} AS key, triplet, CASE WHEN l_linenumber <= 3 THEN 'train' ELSE 'val' END AS split FROM fx_nle),
        m AS (SELECT key, count(DISTINCT triplet) AS n FROM k GROUP BY 1)
        SELECT split, count(*) AS reports, CAST(sum(n) AS BIGINT) AS triplets
        FROM (SELECT DISTINCT split, key FROM k) JOIN m USING (key) GROUP BY 1""",
        "fx_nle",
    ),
    "max_tokens": """
        SELECT doc_id, n_tokens FROM (
            SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM documents)
        WHERE n_tokens <= 100""",
}
