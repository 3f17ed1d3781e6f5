"""Registered queries: text metrics and aligned variants."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.functions import stemming
from strandgraph.functions import text as t
from strandgraph.operators import textmetrics as M
from strandgraph.operators import triplets as T
from strandgraph.plans import fixtures as fx
from strandgraph.plans.fixtures import add_view, with_views


def align_answers(spark, d):
    return fx.text_pairs(spark, d)


def bleu(spark, d):
    out = M.corpus_bleu(fx.text_pairs(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def cider(spark, d):
    return M.cider(fx.text_pairs(spark, d)).select(F.round("cider", 6).alias("cider"))


def cider_rows(spark, d):
    return M.cider_rows(fx.text_pairs(spark, d)).select("id", F.round("cider", 5).alias("cider"))


def meteor(spark, d):
    return M.meteor_rows(fx.text_pairs(spark, d)).select("id", F.round("meteor", 6).alias("meteor"))


def meteor_exact(spark, d):
    """As meteor, with the stage for equal words only."""
    return M.meteor_rows(fx.text_pairs(spark, d), stems=False).select("id", F.round("meteor", 6).alias("meteor"))


def meteor_turns(spark, d):
    """Every turn of a conversation against the one before it."""
    return M.meteor_rows(_turn_pairs(spark, d)).select("id", F.round("meteor", 6).alias("meteor"))


def rouge_l(spark, d):
    return M.rouge_l_rows(fx.text_pairs(spark, d)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


def _turn_pairs(spark, d):
    by = W.partitionBy("conv_id").orderBy("turn")  # one conversation is a small group
    turns = fx.table(spark, d, "conversations").withColumn("hyp", F.lag("text").over(by)).where("hyp IS NOT NULL")
    return turns.select(t.concat(F.col("conv_id").cast("string"), "-", F.col("turn").cast("string")).alias("id"), "hyp", F.col("text").alias("ref"))


def rouge_l_turns(spark, d):
    """Every turn of a conversation against the one before it, by stems."""
    return M.rouge_l_rows(_turn_pairs(spark, d)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


def word_stems(spark, d):
    """Every distinct word of the conversations with its stem, computed once per word."""
    words = fx.table(spark, d, "conversations").select(F.explode(t.ascii_tokens("text")).alias("word")).distinct()
    return words.select("word", M.stemmed("word").alias("stem"))


def rouge_l_unstemmed(spark, d):
    """As rouge_l_turns, with the words as they are."""
    return M.rouge_l_rows(_turn_pairs(spark, d), stemmed=False).select("id", F.round("rouge_l", 6).alias("rouge_l"))


def bleu_multi(spark, d):
    """Every turn of a conversation against all other turns of it."""
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("id"))
    others = turns.select("conv_id", F.col("turn").alias("other"), F.col("text").alias("ref"))
    references = turns.join(others, "conv_id").where("turn <> other").select("id", "ref")  # a conversation is a small group
    return M.multi_bleu(turns.select("id", F.col("text").alias("hyp")), references).select(F.round("bleu", 6).alias("bleu"))


def entity_recall(spark, d):
    out = M.entity_rows(fx.text_pairs(spark, d), fx.FRAGMENTS)
    return out.select("id", F.round("recall", 6).alias("recall"), F.round("hallucination", 6).alias("hallucination"))


def entity_scores(spark, d):
    out = M.entity_scores(fx.text_pairs(spark, d), fx.FRAGMENTS)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def set_f1(spark, d):
    rows = fx.rows_nle(spark, d).select(F.col("study_id").alias("id"), "ord", F.array("triplet").alias("t"), "l_suppkey")
    ref = T.merge_in_order(rows, ["id"], "t", "ord", "ref")
    hyp = T.merge_in_order(rows.where(F.pmod("l_suppkey", F.lit(3)) > 0), ["id"], "t", "ord", "hyp")
    sets = ref.join(hyp, "id", "left").withColumn("hyp", F.coalesce("hyp", F.array().cast("array<string>")))
    return M.set_prf(sets)


def metric_report(spark, d):
    return M.metric_report(fx.text_pairs(spark, d), fx.FRAGMENTS)


QUERIES = {
    f.__name__: f
    for f in (align_answers, bleu, cider, cider_rows, meteor, meteor_exact, meteor_turns, rouge_l, rouge_l_turns, rouge_l_unstemmed, word_stems, bleu_multi, entity_recall, entity_scores, set_f1, metric_report)
}

# --- oracles -----------------------------------------------------------------


def _tok(c: str) -> str:
    s = f"lower({c})"
    for pattern, replacement in M.WORD_RULES:
        s = "regexp_replace({}, '{}', '{}', 'g')".format(s, pattern.replace("'", "''"), replacement.replace("'", "''"))
    return _words(s)


def _words(s: str) -> str:
    return rf"list_filter(regexp_split_to_array({s}, '\s+'), lambda w: w <> '')"


def _grams_view(tok) -> str:
    return f"""
    SELECT id, n, gram, CAST(sum(mine) AS BIGINT) AS h, CAST(sum(1 - mine) AS BIGINT) AS r FROM (
        SELECT id, mine, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
            SELECT id, mine, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
                SELECT id, 1 AS mine, {tok('hyp')} AS w FROM pairs UNION ALL SELECT id, 0, {tok('ref')} FROM pairs),
                (SELECT unnest([1, 2, 3, 4]) AS n)))
    GROUP BY id, n, gram"""


add_view("grams", _grams_view(_tok), ["pairs"])
add_view("raw_grams", _grams_view(_words), ["pairs"])
add_view("toks", f"SELECT id, {_tok('hyp')} AS h, {_tok('ref')} AS r FROM pairs", ["pairs"])
add_view(
    "cider_r",
    """
    WITH f AS (SELECT n, gram, count(*) FILTER (WHERE r > 0) AS df FROM raw_grams GROUP BY ALL),
    w AS (SELECT id, g.n, h, r, ln((SELECT count(*) FROM pairs)) - ln(greatest(1.0, df)) AS idf FROM raw_grams g JOIN f ON f.n = g.n AND f.gram = g.gram),
    p AS (SELECT id, n, sum(CASE WHEN h > 0 THEN least(h * idf, r * idf) * r * idf ELSE 0 END) AS dot,
                 sqrt(sum(h * idf * h * idf)) * sqrt(sum(r * idf * r * idf)) AS norm, sum(h) - sum(r) AS diff FROM w GROUP BY ALL),
    s AS (SELECT id, sum(CASE WHEN norm > 0 THEN dot / norm ELSE dot END) / 4 * 10 AS s, coalesce(sum(diff) FILTER (WHERE n = 2), 0) AS d FROM p GROUP BY 1)
    SELECT pairs.id, coalesce(s * exp(-(d * d) / 72.0), 0.0) AS cider FROM pairs LEFT JOIN s ON s.id = pairs.id""",
    ["raw_grams", "pairs"],
)


def _bleu(n: int) -> str:
    logs = " + ".join(f"ln(CASE WHEN m{i} = 0 THEN 0.1 ELSE m{i} END / greatest(d{i}, 1)) / {n}" for i in range(1, n + 1))
    return f"round(CASE WHEN m1 = 0 THEN 0 ELSE CASE WHEN hl > rl THEN 1 WHEN hl = 0 THEN 0 ELSE exp(1 - rl / hl) END * exp({logs}) END, 6) AS bleu_{n}"


_M = ", ".join(f"CAST(sum(least(h, r)) FILTER (WHERE n = {n}) AS DOUBLE) AS m{n}" for n in range(1, 5))
_D = ", ".join(f"CAST(sum(greatest(len(h) - {n - 1}, 1)) AS DOUBLE) AS d{n}" for n in range(1, 5))
add_view(
    "bleu_one",
    f"""
    SELECT {_bleu(1)}, {_bleu(2)}, {_bleu(4)} FROM (SELECT {_M} FROM grams),
        (SELECT CAST(sum(len(h)) AS DOUBLE) AS hl, CAST(sum(len(r)) AS DOUBLE) AS rl, {_D} FROM toks)""",
    ["grams", "toks"],
)
_HAS = "[" + ", ".join(f"CASE WHEN contains(lower({{c}}), '{f}') THEN '{f}' END" for f in fx.FRAGMENTS) + "]"
add_view(
    "ents",
    f"""
    SELECT id, list_filter({_HAS.format(c='hyp')}, lambda x: x IS NOT NULL) AS h, list_filter({_HAS.format(c='ref')}, lambda x: x IS NOT NULL) AS r FROM pairs""",
    ["pairs"],
)
add_view(
    "ent_rows",
    """
    SELECT id, CASE WHEN len(r) > 0 THEN len(list_filter(h, lambda x: list_contains(r, x))) / len(r) END AS recall,
           CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: NOT list_contains(r, x))) / len(h) END AS hallucination FROM ents""",
    ["ents"],
)

_ASCII = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"

# The stems of the words in word0(w), step by step as a chain of views.


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _sounds(x: str) -> str:
    """Consonants as C, vowels as V; a y is a vowel behind a consonant."""
    s = f"regexp_replace(regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):  # y behind y behind y
        s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
    return s


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_sounds(x)}, 'V+C+'))"


def _short(x: str) -> str:
    return f"({_sounds(x)} = 'VC' OR ({_sounds(x)} LIKE '%CVC' AND right({x}, 1) NOT IN ('w', 'x', 'y')))"


def _ends(x: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in suffixes) + ")"


def _rules(name: str, before: str, rules, least: int, extra: str = "true") -> str:
    listed = "[" + ", ".join(f"['{a}', '{b}']" for a, b in rules) + "]"
    stem = "left(x, length(x) - length(r[1]))"
    return (
        f"{name}_r AS (SELECT w, x, list_filter({listed}, lambda r: ends_with(x, r[1]))[1] AS r FROM {before}), "
        f"{name} AS (SELECT w, CASE WHEN r IS NOT NULL AND {_measure(stem)} > {least} AND {extra} THEN {stem} || r[2] ELSE x END AS x FROM {name}_r)"
    )


_IRREGULAR = "map([" + ", ".join(f"'{k}'" for k in stemming.IRREGULAR) + "], [" + ", ".join(f"'{v}'" for v in stemming.IRREGULAR.values()) + "])"
STEMS = f"""
w1 AS (SELECT w, CASE WHEN ends_with(w, 'sses') THEN {_cut("w", 2)} WHEN ends_with(w, 'ies') THEN CASE WHEN length(w) = 4 THEN {_cut("w", 1)} ELSE {_cut("w", 2)} END
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut("w", 1)} ELSE w END AS x FROM word0),
w2 AS (SELECT *, CASE WHEN ends_with(x, 'ed') THEN {_cut("x", 2)} WHEN ends_with(x, 'ing') THEN {_cut("x", 3)} END AS s FROM w1),
w3 AS (SELECT w, CASE WHEN ends_with(x, 'ied') THEN CASE WHEN length(x) = 4 THEN {_cut("x", 1)} ELSE {_cut("x", 2)} END
  WHEN ends_with(x, 'eed') THEN CASE WHEN {_measure(_cut("x", 3))} > 0 THEN {_cut("x", 1)} ELSE x END
  WHEN s IS NULL OR NOT contains({_sounds("s")}, 'V') THEN x
  WHEN {_ends("s", "at", "bl", "iz")} THEN s || 'e'
  WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND right({_sounds("s")}, 1) = 'C' THEN CASE WHEN right(s, 1) IN ('l', 's', 'z') THEN s ELSE {_cut("s", 1)} END
  WHEN {_measure("s")} = 1 AND {_short("s")} THEN s || 'e' ELSE s END AS x FROM w2),
w4 AS (SELECT w, CASE WHEN ends_with(x, 'y') AND length(x) > 2 AND left(right({_sounds("x")}, 2), 1) = 'C' THEN {_cut("x", 1)} || 'i' ELSE x END AS x FROM w3),
w5 AS (SELECT w, CASE WHEN ends_with(x, 'alli') AND {_measure(_cut("x", 4))} > 0 THEN {_cut("x", 2)} ELSE x END AS x FROM w4),
w6 AS (SELECT w, CASE WHEN ends_with(x, 'logi') AND {_measure(_cut("x", 3))} > 0 THEN {_cut("x", 1)} ELSE x END AS x FROM w5),
{_rules("w7", "w6", stemming.STEP_2, 0)},
{_rules("w8", "w7", stemming.STEP_3, 0)},
{_rules("w9", "w8", [(s, "") for s in stemming.STEP_4], 1, "(r[1] <> 'ion' OR left(right(x, 4), 1) IN ('s', 't'))")},
w10 AS (SELECT w, CASE WHEN ends_with(x, 'e') AND ({_measure(_cut("x", 1))} > 1 OR ({_measure(_cut("x", 1))} = 1 AND NOT {_short(_cut("x", 1))})) THEN {_cut("x", 1)} ELSE x END AS x FROM w9),
w11 AS (SELECT w, CASE WHEN ends_with(x, 'll') AND {_measure(_cut("x", 1))} > 1 THEN {_cut("x", 1)} ELSE x END AS x FROM w10),
stems AS (SELECT w, CASE WHEN map_contains({_IRREGULAR}, w) THEN {_IRREGULAR}[w] WHEN length(w) <= 2 THEN w ELSE x END AS stem FROM w11)"""


def _meteor(toks: str, stems: bool = True) -> str:
    """Equal words by their number from the end, then what is left by its stem and number from the end."""
    counted = "SELECT id, w, i, row_number() OVER (PARTITION BY id, w ORDER BY i DESC) AS k FROM (SELECT id, unnest({0}) AS w, unnest(range(1, len({0}) + 1)) AS i FROM toks)"
    second = f"""
    hu AS (SELECT hw.* FROM hw ANTI JOIN m1 ON m1.id = hw.id AND m1.hi = hw.i), ru AS (SELECT rw.* FROM rw ANTI JOIN m1 ON m1.id = rw.id AND m1.ri = rw.i),
    word0 AS (SELECT w FROM hu UNION SELECT w FROM ru), {STEMS},
    hs AS (SELECT id, stem, i, row_number() OVER (PARTITION BY id, stem ORDER BY i DESC) AS k FROM hu JOIN stems ON stems.w = hu.w),
    rs AS (SELECT id, stem, i, row_number() OVER (PARTITION BY id, stem ORDER BY i DESC) AS k FROM ru JOIN stems ON stems.w = ru.w),
    m AS (SELECT * FROM m1 UNION ALL SELECT hs.id, hs.i, rs.i FROM hs JOIN rs ON hs.id = rs.id AND hs.stem = rs.stem AND hs.k = rs.k)"""
    return f"""
    WITH toks AS ({toks}), hw AS ({counted.format("h")}), rw AS ({counted.format("r")}),
    m1 AS (SELECT hw.id, hw.i AS hi, rw.i AS ri FROM hw JOIN rw ON hw.id = rw.id AND hw.w = rw.w AND hw.k = rw.k),
    {second if stems else "m AS (SELECT * FROM m1)"},
    c AS (SELECT *, CASE WHEN hi - lag(hi) OVER (PARTITION BY id ORDER BY hi) = 1 AND ri - lag(ri) OVER (PARTITION BY id ORDER BY hi) = 1 THEN 0 ELSE 1 END AS new FROM m),
    g AS (SELECT id, CAST(count(*) AS DOUBLE) AS m, CAST(sum(new) AS DOUBLE) AS c FROM c GROUP BY 1)
    SELECT toks.id, round(CASE WHEN g.m IS NULL THEN 0.0 ELSE (m / len(h)) * (m / len(r)) / (0.9 * (m / len(h)) + 0.1 * (m / len(r))) * (1 - 0.5 * pow(c / m, 3)) END, 6) AS meteor
    FROM toks LEFT JOIN g ON g.id = toks.id"""


_PAIR_TOKENS = f"WITH pairs AS ({fx.CTE['pairs']}) {fx.CTE['toks']}"
_TURN_TOKENS = f"""
    SELECT conv_id || '-' || turn AS id, {_tok("coalesce(hyp, '')")} AS h, {_tok("coalesce(text, '')")} AS r
    FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations) WHERE hyp IS NOT NULL"""


WORD_STEMS = f"""
WITH word0 AS (SELECT DISTINCT unnest({_ASCII.format("text")}) AS w FROM conversations),
{STEMS}
SELECT w AS word, stem FROM stems
"""


def _turns(stemmed: bool) -> str:
    """Row by row: a new row of the table is the running maximum of "match ? previous[j - 1] + 1 : previous[j]"."""
    raw = f"""
    raw AS (
      SELECT conv_id || '-' || turn AS id, {_ASCII.format("hyp")} AS h, {_ASCII.format("text")} AS r
      FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations) WHERE hyp IS NOT NULL)"""
    side = "SELECT id, list(CASE WHEN length(t.w) > 3 THEN stem ELSE t.w END ORDER BY i) AS s FROM (SELECT id, unnest({0}) AS w, unnest(range(1, len({0}) + 1)) AS i FROM raw) t JOIN stems ON stems.w = t.w GROUP BY id"
    pairs = f"""
    word0 AS (SELECT DISTINCT unnest(h || r) AS w FROM raw), {STEMS},
    hs AS ({side.format("h")}), rs AS ({side.format("r")}),
    pairs AS (SELECT raw.id, coalesce(hs.s, []) AS h, coalesce(rs.s, []) AS r FROM raw LEFT JOIN hs ON hs.id = raw.id LEFT JOIN rs ON rs.id = raw.id)"""
    return f"""
    WITH RECURSIVE {raw}, {pairs if stemmed else "pairs AS (SELECT * FROM raw)"},
    lcs AS (
      SELECT id, 0 AS i, h, r, list_transform(r, lambda w: 0) AS row FROM pairs
      UNION ALL
      SELECT id, i + 1, h, r, list_transform(x, lambda v, j: list_max(x[1:j])) AS row
      FROM (SELECT id, i, h, r, list_transform(r, lambda w, j: CASE WHEN w = h[i + 1] THEN coalesce(row[j - 1], 0) + 1 ELSE row[j] END) AS x FROM lcs WHERE i < len(h)))
    SELECT id, round(CASE WHEN len(h) + len(r) = 0 THEN 0.0 ELSE 2.0 * coalesce(row[len(r)], 0) / (len(h) + len(r)) END, 6) AS rouge_l FROM lcs WHERE i = len(h)
    """


_HITS = ", ".join(f"coalesce(sum(least(h, r)) FILTER (WHERE n = {n}), 0)::DOUBLE AS m{n}" for n in range(1, 5))
_LENS = ", ".join(f"sum(greatest(hl - {n - 1}, 1))::DOUBLE AS d{n}" for n in range(1, 5))
BLEU_MULTI = f"""
WITH t AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, {_tok("text")} AS w FROM conversations),
g AS (
  SELECT conv_id, turn, id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
best AS (SELECT a.id, a.n, a.gram, a.k AS h, max(b.k) AS r FROM g a JOIN g b ON b.conv_id = a.conv_id AND b.turn <> a.turn AND b.n = a.n AND b.gram = a.gram GROUP BY ALL),
near AS (SELECT a.id, len(a.w) AS hl, arg_min(len(b.w), (abs(len(b.w) - len(a.w)), len(b.w))) AS rl FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn <> a.turn GROUP BY a.id, len(a.w))
SELECT {_bleu(4).replace("bleu_4", "bleu")} FROM (SELECT {_HITS} FROM best), (SELECT sum(hl)::DOUBLE AS hl, sum(rl)::DOUBLE AS rl, {_LENS} FROM near)
"""

ORACLE = {
    "rouge_l_turns": _turns(stemmed=True),
    "rouge_l_unstemmed": _turns(stemmed=False),
    "word_stems": WORD_STEMS,
    "bleu_multi": BLEU_MULTI,
    "align_answers": with_views("SELECT id, hyp, ref FROM pairs", "pairs"),
    "bleu": with_views("SELECT * FROM bleu_one", "bleu_one"),
    "cider": with_views("SELECT round(avg(cider), 6) AS cider FROM cider_r", "cider_r"),
    "cider_rows": with_views("SELECT id, round(cider, 5) AS cider FROM cider_r", "cider_r"),
    "meteor": _meteor(_PAIR_TOKENS),
    "meteor_exact": _meteor(_PAIR_TOKENS, stems=False),
    "meteor_turns": _meteor(_TURN_TOKENS),
    "entity_recall": with_views("SELECT id, round(recall, 6) AS recall, round(hallucination, 6) AS hallucination FROM ent_rows", "ent_rows"),
    "entity_scores": with_views(
        "SELECT round(avg(recall), 6) AS entity_recall, round(avg(hallucination), 6) AS hallucination_rate FROM ent_rows", "ent_rows"
    ),
    "set_f1": with_views(
        """
        WITH e AS (SELECT study_id AS id, unnest(string_split(lower(triplet), ' suggestive of ')) AS x, l_suppkey % 3 > 0 AS mine FROM fx_nle),
        s AS (SELECT id, x, bool_or(mine) AS mine FROM e GROUP BY ALL),
        c AS (SELECT id, count(*) AS r, count(*) FILTER (WHERE mine) AS h FROM s GROUP BY 1),
        p AS (SELECT CASE WHEN h = 0 THEN 0.0 ELSE 1.0 END AS p, CAST(h AS DOUBLE) / r AS rc FROM c)
        SELECT round(avg(p) * 100, 2) AS precision, round(avg(rc) * 100, 2) AS recall,
               round(avg(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END) * 100, 2) AS f1, count(*) AS num_samples FROM p""",
        "fx_nle",
    ),
}
