"""Stand-in views over the test tables, as DataFrames and as the same view in SQL.

Every view covers its tables whole. ``CTE`` holds the SQL of each view;
``with_views`` puts the wanted ones in front of an oracle query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.text import concat
from strandgraph.session import materialize_by


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _s(c: str):
    return F.col(c).cast("string")


# --- reports -----------------------------------------------------------------


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """documents as reports; the language decides which headers a report has."""
    body = F.col("text")
    text = (
        F.when(
            F.col("lang") == "en",
            concat("Report\n EXAMINATION: CHEST ", F.col("source"), "\n \n FINDINGS: ", body, "\n \n IMPRESSION: No change in ", F.col("source"), ".\n"),
        )
        .when(
            F.col("lang") == "de",
            concat("\n REASON FOR EXAM: ", F.col("source"), "\n CHEST, PA AND LATERAL: ", body, "\n CONCLUSION:  \n"),
        )
        .when(F.col("lang") == "fr", concat("\n INDICATION: ", F.col("source"), "\n \n", body))
        .otherwise(body)
    )
    return table(spark, folder, "documents").select(
        concat("p", (F.floor(F.col("doc_id") / 3) + 10000).cast("string")).alias("patient_id"),
        concat("s", (F.col("doc_id") + 50000).cast("string")).alias("report_id"),
        text.alias("text"),
    )


# --- explanation rows --------------------------------------------------------


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its order and, where it has one, its part."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"
    )
    return line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey, "left")


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``order_lines`` with their study, written once, the lines of a study together, for queries that look at them several times.

    They are moved before the long texts are made from them, and not again.
    """
    lines = order_lines(spark, folder).drop("o_orderkey")
    return materialize_by(lines, {"subject_id": (F.col("o_custkey") + 10000).cast("string"), "study_id": _s("l_orderkey")}, "lines")


def rows_by_order(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """l_orderkey and the given columns of ``rows_nle``, with the rows of an order in one partition.

    Only these columns are moved there; what needs the order's other columns is not among them.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    orders = table(spark, folder, "orders").select("o_orderkey")
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"
    )
    known = line.join(part, line.l_partkey == part.p_partkey).withColumn("o_custkey", F.lit(None).cast("long"))
    rows = rows_nle(spark, folder, known).select("l_orderkey", *columns).repartition("l_orderkey")
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def rows_nle(spark: SparkSession, folder: str, lines: DataFrame | None = None, keep: Sequence[Column] = ()) -> DataFrame:
    """lineitem with its order and part as labelled explanation rows."""
    lines = order_lines(spark, folder) if lines is None else lines
    kind = F.lower("p_type")
    # Lines of an order may repeat part and supplier, so quantity and flags take part in the position.
    place = F.col("l_linenumber") * F.lit(10**13) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")
    flags = (F.ascii("l_returnflag") - 65) * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    obj = (
        F.when(F.col("l_returnflag") == "A", F.col("p_name"))
        .when(F.col("l_returnflag") == "N", concat("nation_", F.pmod(F.col("l_suppkey"), F.lit(25)).cast("string")))
        .otherwise(concat(kind, " finish"))
    )
    return (
        lines.where(F.col("p_partkey").isNotNull())
        .select(
            concat("s", _s("l_orderkey"), "#", _s("l_linenumber")).alias("sentence_id"),
            F.when(F.col("l_linestatus") == "O", concat("s", _s("l_orderkey"))).otherwise("").alias("report_id"),
            concat("s", _s("l_orderkey")).alias("study_id"),
            concat("p", (F.col("o_custkey") + 10000).cast("string")).alias("patient_id"),
            F.when(F.col("l_quantity") >= 5, concat("The ", F.col("p_name"), " is ", kind, ". ")).otherwise(" ").alias("nle"),
            F.when(F.col("l_quantity") < 3, F.col("p_name"))
            .otherwise(concat(kind, " suggestive of ", obj))
            .alias("triplet"),
            (place * 4000 + F.col("l_quantity").cast("long") * 40 + flags).alias("ord"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            *keep,
        )
    )


# --- graph -------------------------------------------------------------------


def kg_nodes(spark: SparkSession, folder: str) -> DataFrame:
    def part(name: str, prefix: str, key: str, label: str, title) -> DataFrame:
        return table(spark, folder, name).select(
            concat(prefix, _s(key)).alias("node_index"),
            _s(key).alias("node_id"),
            F.lit(label).alias("node_type"),
            title.alias("node_name"),
            F.lit('"tpc"').alias("node_source"),
        )

    return (
        part("region", "r", "r_regionkey", "exposure", concat('"', F.col("r_name"), '"'))
        .unionByName(part("nation", "n", "n_nationkey", "disease", F.col("n_name")))
        .unionByName(part("supplier", "s", "s_suppkey", "disease", F.col("s_name")))
        .unionByName(part("customer", "c", "c_custkey", "effect/phenotype", F.col("c_name")))
        .unionByName(part("part", "p", "p_partkey", "effect/phenotype", F.col("p_name")))
    )


def kg_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Raw edges, each in both directions, with an ordinal; some ends do not exist."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    kinds = [
        (1, "disease_disease", "associated", "s", "n", table(spark, folder, "supplier").selectExpr("s_suppkey a", "s_nationkey b")),
        (2, "exposure_disease", "linked to", "r", "n", table(spark, folder, "nation").selectExpr("n_regionkey a", "n_nationkey b")),
        (3, "disease_phenotype_negative", "absent", "n", "c", table(spark, folder, "customer").selectExpr("c_nationkey a", "c_custkey b")),
        (4, "disease_phenotype_positive", "present", "s", "p", line.selectExpr("l_suppkey a", "l_partkey b").distinct()),
        (
            5,
            "phenotype_phenotype",
            "seen with",
            "c",
            "p",
            line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey a", "l_partkey b").distinct(),
        ),
        (6, "disease_protein", "coded by", "s", "x", table(spark, folder, "supplier").selectExpr("s_suppkey a", "s_nationkey b")),
    ]
    out = None
    for kind, rel, shown, left, right, ends in kinds:
        one = ends.select(
            F.lit(kind).alias("kind"), F.lit(rel).alias("rel_type"), F.lit(shown).alias("display_relation"),
            concat(left, _s("a")).alias("l"), concat(right, _s("b")).alias("r"),
            F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"),
        )
        out = one if out is None else out.unionByName(one)
    backward = F.col("way") == 1
    return out.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "rel_type",
        "display_relation",
        F.when(backward, F.col("r")).otherwise(F.col("l")).alias("start_id"),
        F.when(backward, F.col("l")).otherwise(F.col("r")).alias("end_id"),
        ((F.col("kind") * 10 + F.col("way")) * F.lit(10**16) + F.col("a") * F.lit(10**8) + F.col("b")).alias("ord"),
    )


TERMS = {
    "Widgets": ["widget", "ring"],
    "Nothing": ["no such name"],
    "Suppliers": ["supplier#00000000"],
    "Nations": ["nation_1", "nation_2", "ation"],
    "Rods": ["old rod", "rod", "large rod"],
}

# --- views as SQL ------------------------------------------------------------

_EDGE_KINDS = """
        SELECT 1 AS kind, 'disease_disease' AS rel_type, 'associated' AS display_relation, 's' AS l, 'n' AS r,
               CAST(s_suppkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b FROM supplier
        UNION ALL SELECT 2, 'exposure_disease', 'linked to', 'r', 'n', n_regionkey, n_nationkey FROM nation
        UNION ALL SELECT 3, 'disease_phenotype_negative', 'absent', 'n', 'c', c_nationkey, c_custkey FROM customer
        UNION ALL SELECT DISTINCT 4, 'disease_phenotype_positive', 'present', 's', 'p', l_suppkey, l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 5, 'phenotype_phenotype', 'seen with', 'c', 'p', o_custkey, l_partkey
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 6, 'disease_protein', 'coded by', 's', 'x', s_suppkey, s_nationkey FROM supplier
"""

CTE = {
    "fx_reports": """
        SELECT 'p' || CAST(doc_id // 3 + 10000 AS VARCHAR) AS patient_id, 's' || CAST(doc_id + 50000 AS VARCHAR) AS report_id,
               CASE lang
                 WHEN 'en' THEN E'Report\\n EXAMINATION: CHEST ' || source || E'\\n \\n FINDINGS: ' || text || E'\\n \\n IMPRESSION: No change in ' || source || E'.\\n'
                 WHEN 'de' THEN E'\\n REASON FOR EXAM: ' || source || E'\\n CHEST, PA AND LATERAL: ' || text || E'\\n CONCLUSION:  \\n'
                 WHEN 'fr' THEN E'\\n INDICATION: ' || source || E'\\n \\n' || text
                 ELSE text END AS text
        FROM documents""",
    "fx_nle": """
        SELECT 's' || l_orderkey || '#' || l_linenumber AS sentence_id,
               CASE WHEN l_linestatus = 'O' THEN 's' || l_orderkey ELSE '' END AS report_id,
               's' || l_orderkey AS study_id, 'p' || (o_custkey + 10000) AS patient_id,
               CASE WHEN l_quantity >= 5 THEN 'The ' || p_name || ' is ' || lower(p_type) || '. ' ELSE ' ' END AS nle,
               CASE WHEN l_quantity < 3 THEN p_name ELSE lower(p_type) || ' suggestive of ' ||
                    CASE l_returnflag WHEN 'A' THEN p_name WHEN 'N' THEN 'nation_' || (l_suppkey % 25)
                                      ELSE lower(p_type) || ' finish' END END AS triplet,
               (l_linenumber * CAST(10000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey) * 4000 + CAST(l_quantity AS BIGINT) * 40
                   + (ascii(l_returnflag) - 65) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS ord,
               l_orderkey, l_linenumber, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_nodes": """
        SELECT 'r' || r_regionkey AS node_index, CAST(r_regionkey AS VARCHAR) AS node_id, 'exposure' AS node_type,
               '"' || r_name || '"' AS node_name, '"tpc"' AS node_source FROM region
        UNION ALL SELECT 'n' || n_nationkey, CAST(n_nationkey AS VARCHAR), 'disease', n_name, '"tpc"' FROM nation
        UNION ALL SELECT 's' || s_suppkey, CAST(s_suppkey AS VARCHAR), 'disease', s_name, '"tpc"' FROM supplier
        UNION ALL SELECT 'c' || c_custkey, CAST(c_custkey AS VARCHAR), 'effect/phenotype', c_name, '"tpc"' FROM customer
        UNION ALL SELECT 'p' || p_partkey, CAST(p_partkey AS VARCHAR), 'effect/phenotype', p_name, '"tpc"' FROM part""",
    "fx_edges": f"""
        SELECT rel_type, display_relation, l || a AS start_id, r || b AS end_id,
               kind * 10 * CAST(10000000000000000 AS BIGINT) + a * 100000000 + b AS ord FROM ({_EDGE_KINDS})
        UNION ALL
        SELECT rel_type, display_relation, r || b, l || a,
               (kind * 10 + 1) * CAST(10000000000000000 AS BIGINT) + a * 100000000 + b FROM ({_EDGE_KINDS})""",
    # Cleaned graph: written with plain window and join steps, apart from the operators' way.
    "nodes": """
        SELECT node_index, node_id, replace(replace(node_type, '/', '__'), '"', '') AS label,
               replace(node_name, '"', '') AS node_name, replace(node_source, '"', '') AS node_source FROM fx_nodes""",
    "edges": """
        SELECT rel_type, display_relation, start_id, end_id, ord AS edge_id FROM (
            SELECT *, row_number() OVER (PARTITION BY list_sort(list_distinct([start_id, end_id, rel_type, display_relation]))
                                         ORDER BY ord) AS rn FROM fx_edges)
        WHERE rn = 1 AND start_id IN (SELECT node_index FROM nodes) AND end_id IN (SELECT node_index FROM nodes)""",
    "undirected": """
        SELECT start_id AS src, end_id AS dst, rel_type, edge_id FROM edges
        UNION ALL SELECT end_id, start_id, rel_type, edge_id FROM edges WHERE start_id <> end_id""",
}

NEEDS = {
    "nodes": ["fx_nodes"],
    "edges": ["fx_edges", "nodes"],
    "undirected": ["edges"],
}


def add_view(name: str, sql: str, needs: list[str] | None = None) -> None:
    CTE[name] = sql
    NEEDS[name] = needs or []


def with_views(query: str, *names: str) -> str:
    """The query with the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    views = ", ".join(f"{n} AS ({CTE[n]})" for n in order)
    body = query.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"

MANUAL = {"nation_7": "NATION_8", "promo finish": "red ring", "old rod": None, "small finish": None}

# --- images ------------------------------------------------------------------

IMAGE_URL = "https://images.example.org/files/"


def image_metadata(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Every order line is an image of its order's study; returnflag and linestatus ride along."""
    if lines is not None:
        return lines.select(*_line_keys(), "l_returnflag", "l_linestatus")
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(*_image_keys(), "l_returnflag", "l_linestatus")


def _dicom() -> Column:
    return F.concat_ws("-", _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"), _s("l_orderkey")).alias("dicom_id")


def _image_keys() -> list[Column]:
    return [(F.col("o_custkey") + 10000).cast("string").alias("subject_id"), _s("l_orderkey").alias("study_id"), _dicom()]


def _line_keys() -> list[Column]:
    """The same of stored lines, which have their study and lie by it."""
    return [F.col("subject_id"), F.col("study_id"), _dicom()]


def image_files(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Images of ``lines`` come with their study."""
    from strandgraph.operators.assembly import STUDY, image_path

    return image_metadata(spark, folder, lines).where(F.col("l_returnflag") != "R").select(
        *([] if lines is None else STUDY), image_path("subject_id", "study_id", "dicom_id").alias("rel_path")
    )


def image_split(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Images of the orders with an urgent or high priority have a split; the others fall back."""
    if lines is not None:
        split = F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split")
        return lines.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(*_line_keys(), split)
    meta = image_metadata(spark, folder)
    orders = table(spark, folder, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(_s("o_orderkey").alias("study_id"))
    return meta.join(orders, "study_id", "left_semi").select(
        "subject_id", "study_id", "dicom_id", F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split")
    )


def label_rows(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Explanation rows with ten label triples taken from base-4 digits of the line's ordinal.

    Rows made from ``stored_lines`` keep their study.
    """
    keys = [] if lines is None else ["subject_id", "study_id"]
    rows = rows_nle(spark, folder, lines, [F.col(k).alias(f"_{k}") for k in keys])
    digits = F.array(*[F.pmod(F.floor(F.col("l_orderkey") / F.lit(4**i)) + F.col("l_linenumber") * (i % 3), F.lit(4)) for i in range(10)])
    flags = F.transform(
        digits,
        lambda g: F.array((g == 0).cast("int"), ((g == 1) | (g == 3)).cast("int"), ((g == 2) | (g == 3)).cast("int")),
    )
    return rows.select(
        "sentence_id", F.col("study_id").alias("report_id"), "patient_id", "nle", F.array("triplet").alias("triplets"), "ord", "l_suppkey", flags.alias("img_labels"),
        *[F.col(f"_{k}").alias(k) for k in keys],
    )


add_view(
    "fx_meta",
    """
    SELECT CAST(o_custkey + 10000 AS VARCHAR) AS subject_id, CAST(l_orderkey AS VARCHAR) AS study_id,
           l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_orderkey AS dicom_id, l_returnflag, l_linestatus, o_orderpriority,
           'p' || substr(CAST(o_custkey + 10000 AS VARCHAR), 1, 2) || '/p' || (o_custkey + 10000) || '/s' || l_orderkey || '/'
               || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_orderkey || '.jpg' AS rel_path
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
_DIGITS = ", ".join(f"(l_orderkey // {4**i} + l_linenumber * {i % 3}) % 4" for i in range(10))
add_view("fx_label_rows", f"SELECT *, [{_DIGITS}] AS digits FROM fx_nle", ["fx_nle"])

# --- generated texts ---------------------------------------------------------

FRAGMENTS = ["tion", "ment", "ungen", "lly", "shwh", "reau", "cion", "schen", "the", "ando"]


def with_stale(answers: DataFrame, column: str = "text") -> DataFrame:
    """Every answer twice, as in a file that was written again: an outdated one first (seen 0), then the real one (seen 1)."""
    old = answers.withColumn(column, F.lit("outdated").cast(answers.schema[column].dataType) if answers.schema[column].dataType.simpleString() == "string" else F.slice(column, 1, 0))
    return old.withColumn("seen", F.lit(0)).unionByName(answers.withColumn("seen", F.lit(1)))


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as reference and an answer to it with words swapped, replaced and left out."""
    from strandgraph.functions import text as t
    from strandgraph.operators.textmetrics import align

    docs = table(spark, folder, "documents").select("doc_id", "text")

    def other(w: Column, i: Column) -> Column:
        swapped = F.when((i % 5 == 0) & (i + 1 < F.size("_w")), F.element_at("_w", i + 2)).when(i % 5 == 1, F.element_at("_w", i)).otherwise(w)
        return F.when(i % 11 == 5, t.concat("qv", (i % 13).cast("string"))).otherwise(swapped)

    kept = F.filter(F.transform("_w", other), lambda w, i: i % 7 != 3)
    answers = docs.withColumn("_w", t.words("text")).select(F.col("doc_id").alias("question_id"), F.array_join(kept, " ").alias("text"))
    return align(docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("ref")), with_stale(answers), "seen").withColumnRenamed("ord", "id")


add_view(
    "pairs",
    r"""
    SELECT id, ref, array_to_string(list_filter(list_transform(w, lambda x, j: CASE
               WHEN (j - 1) % 11 = 5 THEN 'qv' || ((j - 1) % 13) WHEN (j - 1) % 5 = 0 AND j < len(w) THEN w[j + 1] WHEN (j - 1) % 5 = 1 THEN w[j - 1] ELSE x END),
               lambda x, j: (j - 1) % 7 <> 3), ' ') AS hyp
    FROM (SELECT doc_id AS id, text AS ref, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)""",
)
