"""Registered queries: benchmark prompts and scorers, judges, gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import scoring as s
from strandgraph.functions import text as t
from strandgraph.operators import benchmarks as B
from strandgraph.operators import gains as N
from strandgraph.plans import fixtures as fx
from strandgraph.plans.fixtures import add_view, with_views
from strandgraph.sources.markdown import read_markdown_table

# --- multiple choice: parts as problems ---------------------------------------


def _letter(shift: int):
    return F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.pmod(F.col("p_size") + shift, F.lit(5)) + 1).cast("int"))


def problems(spark, d):
    part = fx.table(spark, d, "part")
    choices = F.array("p_type", "p_brand", "p_name")
    return part.select(
        F.col("p_partkey").alias("id"),
        t.concat("What fits  ", F.col("p_name"), "?").alias("question"),
        F.when(F.col("p_size") > 40, "").otherwise(t.concat("Size ", F.col("p_size").cast("string"))).alias("hint"),
        F.lit(None).cast("string").alias("caption"),
        F.when(F.col("p_size") > 25, F.concat(choices, F.array(F.lit("other")))).otherwise(choices).alias("choices"),
        F.pmod(F.col("p_partkey"), F.lit(3)).cast("int").alias("answer"),
        F.when(F.col("p_size") < 10, "").otherwise(t.concat(F.col("p_type"), "\nrule")).alias("lecture"),
        F.when(F.col("p_size") < 5, "").otherwise(t.concat(F.col("p_brand"), " holds.")).alias("solution"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, "image.png").alias("image"),
        "p_size",
    )


def _answers(spark, d, shift: int, smallest: int):
    """An answer text in one of four forms for every part of at least a size."""
    x, y = _letter(shift), _letter(shift + 1)
    form = F.pmod(F.col("p_partkey") + shift, F.lit(4))
    text = (
        F.when(form == 0, x)
        .when(form == 1, t.concat(x, ". as said"))
        .when(form == 2, t.concat("So: The answer is ", x, ". BECAUSE"))
        .otherwise(t.concat("The answer is ", x, ". The answer is ", y, "."))
    )
    prompt = F.when(F.pmod("p_size", F.lit(2)) == 0, "<image>\nq").otherwise("q")
    return fx.table(spark, d, "part").where(F.col("p_size") >= smallest).select(F.col("p_partkey").alias("id"), text.alias("text"), prompt.alias("prompt"))


def mcq_prompt(spark, d):
    out = B.mcq_prompt(problems(spark, d), "QCMLE-LEPA")
    other = B.mcq_prompt(problems(spark, d), "QCLM-AE").select("id", F.col("input").alias("input2"), F.col("output").alias("output2"))
    return out.select("id", "input", "output").join(other, "id")


def mcq_conversations(spark, d):
    return B.mcq_conversations(problems(spark, d), "QCM-LEA")


def few_shot(spark, d):
    every = problems(spark, d)
    # The two examples are the smallest ids of the largest size.
    shots = every.orderBy(F.desc("p_size"), "id").limit(2).withColumn("ord", F.col("id"))
    return B.few_shot(every, shots, "CQM-A")


def few_shot_chat(spark, d):
    every = problems(spark, d)
    shots = every.orderBy(F.desc("p_size"), "id").limit(2).withColumn("ord", F.col("id"))
    out = B.few_shot(every, shots, "QCM-ALE", chat=True)
    flat = F.transform("messages", lambda m: t.concat(m["role"], ":", m["content"]))
    return out.select("id", F.array_join(flat, "||").alias("messages"))


def mcq_accuracy(spark, d):
    return B.mcq_accuracy(problems(spark, d), fx.with_stale(_answers(spark, d, 0, 6)), "seen")


def ensemble(spark, d):
    return B.ensemble(problems(spark, d), *(fx.with_stale(_answers(spark, d, *way)) for way in ((0, 1), (2, 1), (1, 8))), order="seen")


def _options(spark, d):
    part = fx.table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("index"),
        t.concat("Which ", F.col("p_name"), "?").alias("question"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("nan").alias("hint"),
        F.col("p_type").alias("A"),
        F.col("p_brand").alias("B"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("C"),
        F.when(F.col("p_size") > 30, "last").otherwise("None").alias("D"),
    )


def option_rounds(spark, d):
    return _shown_options(B.option_rounds(_options(spark, d)))


def option_single(spark, d):
    """One round, with the request for the letter."""
    return _shown_options(B.option_rounds(_options(spark, d), all_rounds=False, ask_letter=True))


def _shown_options(out):
    return out.select(
        "question_id", F.col("round_id").cast("long").alias("round_id"), "prompt", F.array_join("options", "|").alias("options"), F.array_join("option_char", "").alias("option_char")
    )


# --- yes/no, per-type accuracy -------------------------------------------------


def _binary(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    return fx.table(spark, d, "labels").join(docs, "doc_id")


def confusion(spark, d):
    out = B.confusion(_binary(spark, d), F.col("quality") == 0, F.col("toxic") == 1, "lang")
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "yes_ratio")])


def pope(spark, d):
    rows = _binary(spark, d)
    text = F.when(F.col("quality") == 0, "No, it is not. Yes").when(F.col("toxic") == 1, "Not sure, yes. no").otherwise("Yes")
    answers = rows.select(F.col("doc_id").alias("question_id"), text.alias("text"))
    questions = rows.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("category"))
    labels = rows.select(F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("label"), (-F.col("doc_id")).alias("ord"))
    pairs = B.pope_pairs(answers, questions, labels)
    out = B.confusion(pairs, F.col("pred") == "yes", F.col("label") != "no", "category")
    return out.select("category", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "yes_ratio")])


def accuracy_rollup(spark, d):
    docs = fx.table(spark, d, "documents")
    questions = docs.select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type_id"), F.col("source").alias("data_type"),
        F.when(F.col("n_chars") > 1500, "A").otherwise("B").alias("answer"),
    )
    results = fx.table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("text"))
    return B.seed_accuracy(questions, fx.with_stale(results), order="seen")


# --- VQA answers ---------------------------------------------------------------

VARIANTS = ["Yes", "yes!", "the two", "2", "no, it isnt", "Don't; dont", "1,000 (cats)", "a cat/dog.", "is it 3.5 ?", "the man's hat-trick."]


def _vqa(spark, d):
    known = F.array(*[F.lit(v) for v in VARIANTS])

    def pick(c):
        return F.element_at(known, (F.pmod(c, F.lit(len(VARIANTS))) + 1).cast("int"))

    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    answers = F.array(*[pick(F.col("o_orderkey") * (i % 3) + F.floor(F.col("o_custkey") / (i + 1))) for i in range(10)])
    return orders.select(F.col("o_orderkey").alias("id"), pick(F.col("o_custkey")).alias("pred"), answers.alias("answers"))


def vqa_soft(spark, d):
    return B.soft_vqa_rows(_vqa(spark, d)).select("id", F.round("score", 6).alias("score"))


def st_vqa(spark, d):
    return B.st_vqa_rows(_vqa(spark, d)).select("id", "accuracy", F.round("anls", 6).alias("anls"))


def evalai_normalize(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", s.evalai_normalize("text").alias("answer"))


def textvqa(spark, d):
    """Prompts in three layouts joined to annotations by image and lowered question."""
    part = fx.table(spark, d, "part")
    q = t.concat("What is ", F.initcap("p_name"))
    prompt = (
        F.when(F.col("p_size") < 15, t.concat("OCR tokens: x. Question: ", q, " Short answer:"))
        .when(F.col("p_size") < 30, t.concat("Reference OCR token: a\n", q, "\nAnswer"))
        .otherwise(t.concat(q, "\nAnswer"))
    )
    notes = part.select(F.col("p_partkey").alias("image_id"), q.alias("question"), F.array_repeat(F.col("p_type"), 10).alias("answers"))
    results = part.select(F.col("p_partkey").alias("question_id"), prompt.alias("prompt"), F.when(F.col("p_size") > 20, F.lower("p_type")).otherwise("none").alias("text"))
    return B.soft_vqa_rows(B.textvqa_join(notes, results)).select("id", F.round("score", 6).alias("score"))


def submissions(spark, d):
    """VQA-style submission: every document is a question, labelled ones have a result."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"))
    results = _binary(spark, d).select(F.col("doc_id").alias("question_id"), t.concat("The ", F.col("lang"), ", one!").alias("text"))
    return B.to_submission(B.submission_join(docs, fx.with_stale(results), order="seen"), "vqa")


def submission_gqa(spark, d):
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), t.concat(F.col("p_type"), "..").alias("text"))
    return B.to_submission(rows, "gqa")


# --- reviews and judges ----------------------------------------------------------


def _reviews(spark, d):
    ev = fx.table(spark, d, "events")
    a, b = F.pmod(F.col("user_id"), F.lit(9)) + 1, F.pmod(F.col("event_id"), F.lit(9)) + 1
    sep = F.when(F.col("event_type") == "view", ", ").when(F.col("event_type") == "click", ",").otherwise(" ")
    text = t.concat(a.cast("string"), sep, b.cast("string"), "\nAssistant 1 is better than Assistant 2.")
    return ev.select(F.col("event_id").alias("question_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("category"), text.alias("content"))


def review_parse(spark, d):
    pair = s.parse_pair("content")
    return _reviews(spark, d).select("question_id", pair[0].alias("first"), pair[1].alias("second"), s.clean_review("content").alias("body"))


def review_summary(spark, d):
    rows = _reviews(spark, d).select("question_id", "category", s.parse_pair("content").alias("tuple"), F.lit(None).cast("array<double>").alias("score"))
    return B.review_summary(rows)


def review_prompt(spark, d):
    docs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("category"), F.col("p_name").alias("text"))
    first = docs.select("question_id", t.concat("one ", F.col("text")).alias("text"))
    second = docs.select("question_id", t.concat("two ", F.col("text")).alias("text"))
    rules = spark.createDataFrame([("default", "Assistant", "Rate."), ("PROMO", "Helper", "Rate promo.")], "category string, role string, prompt string")
    return B.review_prompt(docs, first, second, rules)


def review_prompt_visual(spark, d):
    """The strict form: a rule per category under a prefix, captions and boxes in front."""
    docs = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_type").alias("category"), F.col("p_name").alias("text"), F.col("p_brand").alias("image")
    )
    first = docs.select("question_id", t.concat("one ", F.col("text")).alias("text"))
    second = docs.select("question_id", t.concat("two ", F.col("text")).alias("text"))
    kinds = docs.select("category").distinct()
    rules = kinds.select(t.concat("visual_", F.col("category")).alias("category"), F.lit("Assistant").alias("role"), t.concat("Rate ", F.col("category"), ".").alias("prompt"))
    context = docs.select("image").distinct().select("image", F.array(F.lit("cap"), F.col("image")).alias("captions"), F.array(F.lit("box: [0, 1]"), F.lit("b")).alias("boxes"))
    return B.review_prompt(docs, first, second, rules, fallback=None, category_prefix="visual_", context=context)


def table_review(spark, d):
    docs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("category"), F.col("p_name").alias("text"))
    answers = {"left": docs.select("question_id", "category", F.col("category").alias("text")), "right": docs}
    review = _reviews(spark, d).select("question_id", "content", s.parse_pair("content").alias("tuple"))
    out = B.table_review(docs, answers, review)
    return out.select("id", "category", "question", "left", "right", "evaluation", F.col("score")[0].alias("score"))


def resume_skip(spark, d):
    questions = fx.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"))
    return B.resume_skip(questions, fx.table(spark, d, "labels").select(F.col("doc_id").alias("question_id")))


def _replies(spark, d):
    ev = fx.table(spark, d, "events")
    k = F.pmod(F.col("user_id"), F.lit(5)) + 1
    body = F.format_string(
        '{"clinical_accuracy": %d, "completeness": %d, "reasoning_quality": 3.5, "language_quality": 4}', k, F.pmod(F.col("event_id"), F.lit(5)) + 1
    )
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", body)
        .when(kind == "click", t.concat("Sure:\n```json\n", body, "\n```\nDone"))
        .when(kind == "signup", t.concat("I say ", body, " ok"))
        .when(kind == "error", "no scores here")
        .otherwise(t.concat('{"clinical_accuracy": ', k.cast("string"), ', "completeness": "high"}'))
    )
    return ev.select(F.col("event_id").alias("id"), text.alias("text"))


def judge_parse(spark, d):
    p = s.parse_judge("text")
    return _replies(spark, d).select("id", *[p[x].alias(x) for x in s.JUDGE_DIMS])


def judge_summary(spark, d):
    return B.judge_summary(_replies(spark, d))


# --- variants --------------------------------------------------------------------


def align_variants(spark, d):
    orders = fx.table(spark, d, "orders")
    base = orders.select(
        F.col("o_orderkey").alias("question_id"), F.col("o_custkey").cast("string").alias("image"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("reference"), "o_totalprice"
    )

    def variant(low: float, cut: float):
        data = base.where(F.col("o_totalprice") >= low)
        answers = data.where(F.col("o_totalprice") >= cut).select("question_id", t.concat("a", F.pmod("question_id", F.lit(2)).cast("string")).alias("text"))
        return data.select("question_id", "image", "question", "reference"), answers

    out = B.align_variants({"base": variant(0, 100000), "onto": variant(50000, 100000), "graph": variant(80000, 200000)})
    shown = F.transform(F.map_entries("variants"), lambda e: t.concat(e["key"], "=", F.coalesce(e["value"], F.lit("?"))))
    return out.select("image", "question", "reference", F.array_join(F.array_sort(shown), ",").alias("variants"), "is_complete", "texts_match")


# --- gains -----------------------------------------------------------------------


def _metrics(spark, d):
    """Mean line measures per supplier nation (model) and returnflag (condition; R is the base)."""
    line = fx.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount")
    supplier = fx.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = fx.table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    means = joined.groupBy(F.col("n_name").alias("model"), F.col("l_returnflag").alias("condition")).agg(
        F.round(F.avg("l_quantity") / 10, 4).alias("overall"), F.round(F.avg("l_extendedprice") / 1000, 4).alias("cider"), F.round(F.avg("l_discount") * 100, 4).alias("hallucination_rate")
    )
    return means.unpivot(["model", "condition"], ["overall", "cider", "hallucination_rate"], "metric", "value")


def gains(spark, d):
    out = N.gains(_metrics(spark, d), base="R")
    # Adding zero turns a negative zero into a plain one.
    return out.select("condition", "model", "metric", F.round("base", 4).alias("base"), (F.round("gain", 4) + F.lit(0.0)).alias("gain"))


def markdown_table(spark, d):
    """A metric table written as markdown lines from the tables and read back; blank model cells are filled down."""
    line = fx.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    supplier = fx.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = fx.table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cells = joined.groupBy("n_nationkey", "n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    first = F.col("l_returnflag") == "A"
    name = F.when(first, t.concat("**", F.col("n_name"), "**")).otherwise("")
    shown = t.concat("| ", name, " | ", F.col("l_returnflag"), " | ", F.col("n").cast("string"), " | **", F.col("q").cast("string"), "**/5 |")
    place = F.col("n_nationkey") * 10 + F.when(first, 1).when(F.col("l_returnflag") == "N", 2).otherwise(3) + 10
    body = cells.select(F.lit("table.md").alias("path"), place.alias("line_no"), shown.alias("line"))
    head = spark.createDataFrame(
        [("table.md", 0, "## Counts"), ("table.md", 2, "| Model | Flag | rows | quantity |"), ("table.md", 3, "|---|---|---|---|"), ("table.md", 10**9, "## End")],
        "path string, line_no int, line string",
    )
    return read_markdown_table(head.unionByName(body), "## Counts", ["rows", "quantity"], ["A", "N", "R"])


def gain_summary(spark, d):
    table = N.gain_table(N.gains(_metrics(spark, d), base="R"), ["overall", "cider"])
    out = N.gain_summary(table)
    numbers = ["pearson", "slope", "intercept", "weak_mean", "strong_mean", "median_gain", "max_gain", "min_gain", "median_auto_gain", "mean_auto_gain"]
    return out.select(
        "condition", "n", *[F.round(c, 5).alias(c) for c in numbers], "nonpositive_gain_count", "small_gain_count",
        F.array_join("weak_models", "|").alias("weak_models"), "stronger_gap",
    )


def gain_observations(spark, d):
    table = N.gain_table(N.gains(_metrics(spark, d), base="R"), ["overall", "cider"])
    out = N.observations(N.gain_summary(table))
    return out.select("condition", F.col("line_no").cast("long").alias("line_no"), "line")


QUERIES = {
    f.__name__: f
    for f in (
        mcq_prompt, mcq_conversations, few_shot, few_shot_chat, mcq_accuracy, ensemble, option_rounds, option_single, review_prompt_visual, confusion, pope,
        accuracy_rollup, vqa_soft, st_vqa, evalai_normalize, textvqa, submissions, submission_gqa, review_parse,
        review_summary, review_prompt, table_review, resume_skip, judge_parse, judge_summary, align_variants, gains, markdown_table,
        gain_summary, gain_observations,
    )
}

# --- oracles ---------------------------------------------------------------------

add_view(
    "probs",
    r"""
    SELECT p_partkey AS id, 'What fits  ' || p_name || '?' AS question, CASE WHEN p_size > 40 THEN '' ELSE 'Size ' || p_size END AS hint,
           CASE WHEN p_size > 25 THEN [p_type, p_brand, p_name, 'other'] ELSE [p_type, p_brand, p_name] END AS choices, p_partkey % 3 AS answer,
           CASE WHEN p_size < 10 THEN '' ELSE p_type || chr(10) || 'rule' END AS lecture, CASE WHEN p_size < 5 THEN '' ELSE p_brand || ' holds.' END AS solution,
           CASE WHEN p_size % 2 = 0 THEN 'image.png' END AS image, p_size,
           'What fits ' || p_name || '?' AS q, CASE WHEN p_size > 40 THEN 'N/A' ELSE 'Size ' || p_size END AS ctx,
           '(A) ' || p_type || ' (B) ' || p_brand || ' (C) ' || p_name || CASE WHEN p_size > 25 THEN ' (D) other' ELSE '' END AS choice,
           chr(65 + CAST(p_partkey % 3 AS INTEGER)) AS letter
    FROM part""",
)


def _answer_view(shift: int, smallest: int) -> str:
    x, y = f"chr(65 + (p_size + {shift}) % 5)", f"chr(65 + (p_size + {shift + 1}) % 5)"
    return f"""
    SELECT p_partkey AS id, p_size % 2 = 0 AS image, CASE (p_partkey + {shift}) % 4 WHEN 0 THEN {x} WHEN 1 THEN {x} || '. as said' WHEN 2 THEN 'So: The answer is ' || {x} || '. BECAUSE'
           ELSE 'The answer is ' || {x} || '. The answer is ' || {y} || '.' END AS text,
           (p_partkey + {shift}) % 4 AS form, (p_size + {shift}) % 5 AS k
    FROM part WHERE p_size >= {smallest}"""


add_view("ans0", _answer_view(0, 1))
add_view("ans2", _answer_view(2, 1))
add_view("ans1", _answer_view(1, 8))
add_view("ans6", _answer_view(0, 6))
# Only the third form states one letter; an index beyond the choices is -1.
_IDX = "CASE WHEN {a}.form = 2 AND {a}.k < len(choices) THEN {a}.k ELSE -1 END"
_SHOTS = "(SELECT * FROM probs ORDER BY p_size DESC, id LIMIT 2)"
_CQM = "'Context: ' || ctx || chr(10) || 'Question: ' || q || chr(10) || 'Options: ' || choice || chr(10)"
_QCM = "'Question: ' || q || chr(10) || 'Context: ' || ctx || chr(10) || 'Options: ' || choice"

_NUM = ", ".join(f"'{k}': '{v}'" for k, v in s.NUMBER_WORDS.items())


def _q(text: str) -> str:
    return text.replace("'", "''")


_CON = ", ".join(f"'{_q(k)}': '{_q(v)}'" for k, v in s.CONTRACTIONS.items())
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _norm_view(source: str) -> str:
    """Answer normalisation of the texts (key, text) of a view, step by step."""
    out = "t0"
    for p in s.PUNCTUATION:
        m = _q(p)
        out = f"replace({out}, '{m}', CASE WHEN grouped OR contains(t0, '{m} ') OR contains(t0, ' {m}') THEN '' ELSE ' ' END)"
    # At most 32 periods without a digit behind them are removed.
    return rf"""
    WITH a AS (SELECT DISTINCT text, trim(replace(replace(trim(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s'), {_WS}), chr(10), ' '), chr(9), ' '), {_WS}) AS t0 FROM {source}),
    b AS (SELECT text, t0, regexp_matches(t0, '\d,+\d') AS grouped FROM a),
    c AS (SELECT text, {out} AS t1 FROM b),
    d AS (SELECT text, string_split(regexp_replace(regexp_replace(t1 || ' ', '\.([^0-9.])', chr(1) || '\1', 'g'), '\.([^0-9])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM c),
    e AS (SELECT text, CASE WHEN len(parts) > 33 THEN array_to_string(parts[1:33], '') || '.' || array_to_string(parts[34:], '.') ELSE array_to_string(parts, '') END AS t2 FROM d),
    f AS (SELECT text, list_filter(regexp_split_to_array(lower(t2), '\s+'), lambda w: w <> '') AS w, MAP {{{_NUM}}} AS nums, MAP {{{_CON}}} AS cons FROM e),
    g AS (SELECT text, cons, list_filter(list_transform(w, lambda x: coalesce(nums[x], x)), lambda x: x NOT IN ('a', 'an', 'the')) AS w FROM f)
    SELECT text, array_to_string(list_transform(w, lambda x: coalesce(cons[x], x)), ' ') AS norm FROM g"""


_VAR = "[" + ", ".join(f"'{_q(v)}'" for v in VARIANTS) + "]"
add_view(
    "vqa",
    f"""
    SELECT o_orderkey AS id, {_VAR}[o_custkey % 10 + 1] AS pred, i, {_VAR}[(o_orderkey * (i % 3) + o_custkey // (i + 1)) % 10 + 1] AS ans
    FROM orders, (SELECT unnest(range(0, 10)) AS i)""",
)
add_view("vqa_norm", _norm_view(f"(SELECT unnest({_VAR}) AS text)"))
add_view("conv_norm", _norm_view("conversations"))
add_view(
    "revs",
    """
    SELECT event_id AS question_id, CASE WHEN event_type <> 'error' THEN event_type END AS category, event_type,
           user_id % 9 + 1 AS a, event_id % 9 + 1 AS b,
           CASE WHEN event_type = 'view' THEN -1.0 ELSE user_id % 9 + 1 END AS first, CASE WHEN event_type = 'view' THEN -1.0 ELSE event_id % 9 + 1 END AS second FROM events""",
)
add_view(
    "metr",
    """
    SELECT n_name AS model, l_returnflag AS condition, round(avg(l_quantity) / 10, 4) AS overall, round(avg(l_extendedprice) / 1000, 4) AS cider, round(avg(l_discount) * 100, 4) AS hallucination_rate
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)
add_view(
    "gsum",
    """
    WITH g AS (SELECT c.condition, c.model, b.overall AS x, c.overall - b.overall AS y, c.cider - b.cider AS a
               FROM metr c JOIN metr b ON b.model = c.model AND b.condition = 'R' WHERE c.condition <> 'R'),
    k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY x, model) AS rn, count(*) OVER (PARTITION BY condition) AS n FROM g)
    SELECT condition, count(*) AS n, corr(y, x) AS pearson, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
           avg(y) FILTER (WHERE rn <= n // 2) AS weak_mean, avg(y) FILTER (WHERE rn > n // 2) AS strong_mean,
           list_sort(list(y))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median_gain, max(y) AS max_gain, min(y) AS min_gain,
           list_sort(list(a))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median_auto_gain, avg(a) AS mean_auto_gain,
           count(*) FILTER (WHERE y <= 0) AS nonpositive_gain_count, count(*) FILTER (WHERE y >= 0.05 AND y <= 0.15) AS small_gain_count,
           string_agg(model, '|' ORDER BY rn) FILTER (WHERE rn <= n // 2) AS weak_models,
           avg(y) FILTER (WHERE rn <= n // 2) > avg(y) FILTER (WHERE rn > n // 2) AS stronger_gap
    FROM k GROUP BY condition""",
    ["metr"],
)
_RATES = """round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
            round((tp + fp) / (tp + fp + tn + fn), 6) AS yes_ratio, round(2 * tp / nullif(tp + fp, 0) * tp / nullif(tp + fn, 0) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1"""
add_view(
    "judged",
    """
    SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(user_id % 5 + 1 AS DOUBLE) END AS clinical_accuracy,
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(event_id % 5 + 1 AS DOUBLE) END AS completeness,
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(3.5 AS DOUBLE) END AS reasoning_quality,
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(4 AS DOUBLE) END AS language_quality FROM events""",
)
_V = {"base": (0, 100000), "onto": (50000, 100000), "graph": (80000, 200000)}
_LAST = ", ".join(f"max(CASE WHEN v = '{v}' THEN question_id END) AS q_{v}, arg_max(txt, question_id) FILTER (WHERE v = '{v}') AS t_{v}" for v in _V)
_ROWS = " UNION ALL ".join(
    f"SELECT '{v}' AS v, o_orderkey AS question_id, CAST(o_custkey AS VARCHAR) AS image, o_orderpriority AS question, o_orderstatus AS reference, CASE WHEN o_totalprice >= {cut} THEN 'a' || (o_orderkey % 2) ELSE '?' END AS txt FROM orders WHERE o_totalprice >= {low}"
    for v, (low, cut) in _V.items()
)

ORACLE = {
    "markdown_table": """
        WITH c AS (SELECT n_name AS model, l_returnflag AS condition, CAST(count(*) AS DOUBLE) AS n, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS q
                   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
        SELECT 'table.md' AS path, model, condition, 'rows' AS metric, n AS value FROM c UNION ALL SELECT 'table.md', model, condition, 'quantity', q FROM c""",
    "mcq_conversations": with_views(
        f"""
        SELECT id, CASE WHEN image IS NOT NULL THEN id || '/' || image END AS image,
               substr({_QCM}, 11) || CASE WHEN image IS NOT NULL THEN chr(10) || '<image>' ELSE '' END AS instruction,
               substr(replace('Answer: ' || le || ' ' || solution || ' The answer is ' || letter || '.', '  ', ' '), 9) AS output
        FROM (SELECT *, replace(lecture, chr(10), chr(92) || 'n') AS le FROM probs)""",
        "probs",
    ),
    "few_shot": with_views(
        f"""
        SELECT id, (SELECT string_agg({_CQM} || 'Answer: The answer is ' || letter || '.', chr(10) || chr(10) ORDER BY id) FROM {_SHOTS}) || chr(10) || chr(10) || {_CQM} || 'Answer:' AS prompt
        FROM probs""",
        "probs",
    ),
    "few_shot_chat": with_views(
        f"""
        WITH p AS (SELECT *, {_QCM} AS inp, 'Answer: The answer is ' || letter || '. BECAUSE: ' || replace(lecture, chr(10), chr(92) || 'n') || ' ' || solution AS outp FROM probs)
        SELECT id, 'system:You are a helpful assistant.||' ||
               (SELECT string_agg('user:' || inp || '||assistant:' || outp, '||' ORDER BY id) FROM (SELECT * FROM p ORDER BY p_size DESC, id LIMIT 2)) ||
               '||user:' || inp || '||assistant:Answer:' AS messages FROM p""",
        "probs",
    ),
    "mcq_accuracy": with_views(
        """
        WITH j AS (SELECT p.*, a.image AS img, CASE WHEN form <= 2 AND k < len(choices) THEN k ELSE -1 END = answer AND a.id IS NOT NULL AS ok
                   FROM probs p LEFT JOIN ans6 a ON a.id = p.id)
        SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE img) AS image_total, count(*) FILTER (WHERE img AND ok) AS image_correct,
               round(100.0 * count(*) FILTER (WHERE ok) / count(*), 2) AS pct, round(100.0 * count(*) FILTER (WHERE img AND ok) / count(*) FILTER (WHERE img), 2) AS image_pct FROM j""",
        "probs",
        "ans6",
    ),
    "ensemble": with_views(
        f"""
        WITH j AS (SELECT answer, {_IDX.format(a='o')} AS o, {_IDX.format(a='p')} AS p, p.form <> 2 AS pf,
                          CASE WHEN q.id IS NULL OR q.form <> 2 THEN {_IDX.format(a='o')} ELSE {_IDX.format(a='q')} END AS q, q.id IS NULL AS miss
                   FROM probs JOIN ans0 o ON o.id = probs.id JOIN ans2 p ON p.id = probs.id LEFT JOIN ans1 q ON q.id = probs.id)
        SELECT count(*) AS total, count(*) FILTER (WHERE CASE WHEN pf THEN o ELSE p END = answer) AS correct, count(*) FILTER (WHERE o = answer OR p = answer) AS correct_upperbound,
               count(*) FILTER (WHERE pf) AS partner_failed, count(*) FILTER (WHERE o = answer) AS our_correct, count(*) FILTER (WHERE p = answer) AS partner_correct,
               count(*) FILTER (WHERE q = answer) AS requery_correct, count(*) FILTER (WHERE miss) AS missing_requery FROM j""",
        "probs",
        "ans0",
        "ans1",
        "ans2",
    ),
    "option_rounds": """
        WITH o AS (SELECT *, CASE WHEN p_size <= 10 THEN [p_type, p_brand] WHEN p_size <= 30 THEN [p_type, p_brand, p_name] ELSE [p_type, p_brand, p_name, 'last'] END AS opts FROM part),
        r AS (SELECT *, unnest(range(0, len(opts))) AS r FROM o),
        t AS (SELECT *, opts[r + 1:] || opts[:r] AS ro, substr('ABCD', CAST(r + 1 AS INTEGER), CAST(len(opts) - r AS INTEGER)) || substr('ABCD', 1, CAST(r AS INTEGER)) AS oc FROM r)
        SELECT p_partkey AS question_id, r AS round_id, CASE WHEN p_size > 20 THEN p_brand || chr(10) ELSE '' END || 'Which ' || p_name || '?' ||
               array_to_string(list_transform(ro, lambda x, i: chr(10) || substr('ABCD', CAST(i AS INTEGER), 1) || '. ' || x), '') AS prompt,
               array_to_string(ro, '|') AS options, oc AS option_char FROM t""",
    "option_single": """
        WITH o AS (SELECT *, CASE WHEN p_size <= 10 THEN [p_type, p_brand] WHEN p_size <= 30 THEN [p_type, p_brand, p_name] ELSE [p_type, p_brand, p_name, 'last'] END AS opts FROM part)
        SELECT p_partkey AS question_id, CAST(0 AS BIGINT) AS round_id, CASE WHEN p_size > 20 THEN p_brand || chr(10) ELSE '' END || 'Which ' || p_name || '?' ||
               array_to_string(list_transform(opts, lambda x, i: chr(10) || substr('ABCD', CAST(i AS INTEGER), 1) || '. ' || x), '') ||
               chr(10) || 'Answer with the option''s letter from the given choices directly.' AS prompt,
               array_to_string(opts, '|') AS options, substr('ABCD', 1, CAST(len(opts) AS INTEGER)) AS option_char FROM o""",
    "confusion": f"""
        SELECT *, {_RATES} FROM (
            SELECT lang, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp,
                   count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn
            FROM labels JOIN documents USING (doc_id) GROUP BY 1)""",
    "pope": f"""
        WITH b AS (SELECT doc_id, lang, quality = 1 AS yes, toxic = 0 AS lab, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS j
                   FROM labels JOIN documents USING (doc_id)),
        z AS (SELECT a.lang AS category, a.yes, l.lab FROM b a JOIN b l ON l.lang = a.lang AND l.j = a.i)
        SELECT *, {_RATES} FROM (
            SELECT category, count(*) FILTER (WHERE yes AND lab) AS tp, count(*) FILTER (WHERE yes AND NOT lab) AS fp,
                   count(*) FILTER (WHERE NOT yes AND NOT lab) AS tn, count(*) FILTER (WHERE NOT yes AND lab) AS fn FROM z GROUP BY 1)""",
    "accuracy_rollup": """
        WITH j AS (SELECT lang, coalesce(CASE WHEN quality = 1 THEN 'A' ELSE 'B' END = CASE WHEN n_chars > 1500 THEN 'A' ELSE 'B' END AND quality IS NOT NULL, false) AS ok
                   FROM documents LEFT JOIN labels USING (doc_id)),
        e AS (SELECT lang, ok FROM j UNION ALL SELECT 'all', ok FROM j)
        SELECT lang AS question_type_id, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 2) AS pct FROM e GROUP BY 1""",
    "vqa_soft": with_views(
        """
        WITH c AS (SELECT id, count(*) FILTER (WHERE n.norm = p.norm) AS c FROM vqa JOIN vqa_norm n ON n.text = ans JOIN vqa_norm p ON p.text = pred GROUP BY 1)
        SELECT id, round(CASE WHEN c = 0 THEN 0.0 ELSE (c * least(1.0, CAST(c - 1 AS DOUBLE) / 3) + (10 - c) * least(1.0, CAST(c AS DOUBLE) / 3)) / 10 END, 6) AS score FROM c""",
        "vqa",
        "vqa_norm",
    ),
    "st_vqa": with_views(
        """
        WITH c AS (SELECT id, n.norm = p.norm AS hit, 1 - levenshtein(trim(lower(pred)), trim(lower(ans))) / greatest(length(trim(pred)), length(trim(ans))) AS iou
                   FROM vqa JOIN vqa_norm n ON n.text = ans JOIN vqa_norm p ON p.text = pred)
        SELECT id, CASE WHEN bool_or(hit) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS accuracy, round(max(CASE WHEN iou >= 0.5 THEN iou ELSE 0 END), 6) AS anls FROM c GROUP BY 1""",
        "vqa",
        "vqa_norm",
    ),
    "evalai_normalize": with_views("SELECT conv_id, turn, norm AS answer FROM conversations c JOIN conv_norm n ON n.text = c.text", "conv_norm"),
    "textvqa": "SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM part",
    "submissions": """
        SELECT doc_id AS question_id, CASE WHEN quality IS NULL THEN '' ELSE lang || ' 1' END AS answer FROM documents LEFT JOIN labels USING (doc_id)""",
    "submission_gqa": "SELECT p_partkey AS \"questionId\", lower(p_type) AS prediction FROM part",
    "review_parse": with_views(
        """
        SELECT question_id, CAST(first AS DOUBLE) AS first, CAST(second AS DOUBLE) AS second, '**Assistant 1** is better than **Assistant 2**.' AS body FROM revs""",
        "revs",
    ),
    "review_summary": with_views(
        """
        WITH e AS (SELECT category, first, second FROM revs WHERE category IS NOT NULL UNION ALL SELECT 'all', first, second FROM revs),
        m AS (SELECT category, round(avg(CAST(first AS DOUBLE)), 3) AS a, round(avg(CAST(second AS DOUBLE)), 3) AS b FROM e GROUP BY 1)
        SELECT category, round(b / a * 100, 1) AS ratio, round(a * 10, 1) AS first, round(b * 10, 1) AS second FROM m""",
        "revs",
    ),
    "review_prompt": """
        SELECT p_partkey AS question_id, p_type AS category, E'[Question]\\n' || p_name || E'\\n\\n[' || r || E' 1]\\none ' || p_name || E'\\n\\n[End of ' || r || E' 1]\\n\\n[' || r || E' 2]\\ntwo ' ||
               p_name || E'\\n\\n[End of ' || r || E' 2]\\n\\n[System]\\n' || pr || E'\\n\\n' AS content
        FROM (SELECT *, CASE p_type WHEN 'PROMO' THEN 'Helper' ELSE 'Assistant' END AS r, CASE p_type WHEN 'PROMO' THEN 'Rate promo.' ELSE 'Rate.' END AS pr FROM part)""",
    "review_prompt_visual": """
        SELECT p_partkey AS question_id, p_type AS category, E'[Context]\\ncap\\n' || p_brand || E'\\n\\nbox: [0, 1]\\nb\\n\\n[Question]\\n' || p_name || E'\\n\\n[Assistant 1]\\none ' || p_name ||
               E'\\n\\n[End of Assistant 1]\\n\\n[Assistant 2]\\ntwo ' || p_name || E'\\n\\n[End of Assistant 2]\\n\\n[System]\\nRate ' || p_type || E'.\\n\\n' AS content FROM part""",
    "table_review": with_views(
        """
        WITH a AS (SELECT *, CASE WHEN p_partkey <= 20 THEN p_partkey + 60 ELSE p_partkey - 20 END AS x FROM part),
        b AS (SELECT *, CASE WHEN x <= 50 THEN x + 10 WHEN x <= 60 THEN x - 50 ELSE x END AS y FROM a)
        SELECT CASE WHEN y = 7 THEN 1 WHEN y < 7 THEN y + 1 ELSE y END AS id, p_type AS category, p_name AS question, p_type AS "left", p_name AS "right",
               '**Assistant 1** is better than **Assistant 2**.' AS evaluation, CAST(first AS DOUBLE) AS score FROM b JOIN revs ON question_id = p_partkey""",
        "revs",
    ),
    "resume_skip": "SELECT doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "judge_parse": with_views("SELECT * FROM judged", "judged"),
    "judge_summary": with_views(
        """
        SELECT *, round((clinical_accuracy + completeness + reasoning_quality + language_quality) / 4, 2) AS overall FROM (
            SELECT round(avg(clinical_accuracy), 2) AS clinical_accuracy, round(avg(completeness), 2) AS completeness, round(avg(reasoning_quality), 2) AS reasoning_quality,
                   round(avg(language_quality), 2) AS language_quality, count(clinical_accuracy) AS num_scored, count(*) AS num_samples FROM judged)""",
        "judged",
    ),
    "align_variants": f"""
        WITH r AS ({_ROWS}), g AS (SELECT image, question, reference, {_LAST} FROM r GROUP BY ALL)
        SELECT image, question, reference, array_to_string(list_sort(list_filter([CASE WHEN q_base IS NOT NULL THEN 'base=' || t_base END, CASE WHEN q_graph IS NOT NULL THEN 'graph=' || t_graph END,
                   CASE WHEN q_onto IS NOT NULL THEN 'onto=' || t_onto END], lambda x: x IS NOT NULL)), ',') AS variants,
               q_base IS NOT NULL AND q_onto IS NOT NULL AND q_graph IS NOT NULL AS is_complete,
               coalesce(q_base IS NOT NULL AND q_onto IS NOT NULL AND q_graph IS NOT NULL AND t_base = t_onto AND t_base = t_graph, false) AS texts_match FROM g""",
    "gains": with_views(
        """
        WITH u AS (SELECT model, condition, unnest(['overall', 'cider', 'hallucination_rate']) AS metric, unnest([overall, cider, hallucination_rate]) AS value FROM metr)
        SELECT c.condition, c.model, c.metric, round(b.value, 4) AS base, round(CASE WHEN c.metric = 'hallucination_rate' THEN b.value - c.value ELSE c.value - b.value END, 4) + 0.0 AS gain
        FROM u c JOIN u b ON b.model = c.model AND b.metric = c.metric AND b.condition = 'R' WHERE c.condition <> 'R'""",
        "metr",
    ),
    "gain_summary": with_views(
        "SELECT condition, n, "
        + ", ".join(f"round({c}, 5) AS {c}" for c in ("pearson", "slope", "intercept", "weak_mean", "strong_mean", "median_gain", "max_gain", "min_gain", "median_auto_gain", "mean_auto_gain"))
        + ", nonpositive_gain_count, small_gain_count, weak_models, stronger_gap FROM gsum",
        "gsum",
    ),
    "gain_observations": with_views(
        """
        WITH l AS (SELECT condition, [
            format('{} Pearson correlation between Base Overall and gain is {:.3f}.', condition, pearson),
            format('{} weak-half mean gain is {:.2f}, versus {:.2f} for the strong half.', condition, weak_mean, strong_mean),
            format('{} median CIDEr gain is {:.2f}, while median Overall gain is {:.2f}.', condition, median_auto_gain, median_gain),
            format('{} small Overall gains (0.05 to 0.15) occur in {}/{} models.', condition, small_gain_count, n)] AS ls FROM gsum)
        SELECT condition, unnest([0, 1, 2, 3]) AS line_no, unnest(ls) AS line FROM l""",
        "gsum",
    ),
}
_BEC = "CASE WHEN trim(le || solution) = '' THEN '' ELSE chr(10) || 'BECAUSE: ' || trim(le || ' ' || solution) END"
ORACLE["mcq_prompt"] = with_views(
    f"""
    SELECT id, {_QCM} || {_BEC} AS input,
           trim(CASE WHEN le <> '' THEN 'LECTURE: ' || le || chr(10) ELSE '' END || CASE WHEN solution <> '' THEN 'SOLUTION: ' || solution || chr(10) ELSE '' END || '###' || chr(10) || 'ANSWER: ' || letter || '.') AS output,
           'Question: ' || q || chr(10) || 'Context: ' || ctx || chr(10) || 'BECAUSE: ' || le || chr(10) || 'Options: ' || choice AS input2,
           'Answer: The answer is ' || letter || '.' || CASE WHEN le = '' THEN '' ELSE ' BECAUSE: ' || le END AS output2
    FROM (SELECT *, replace(lecture, chr(10), chr(92) || 'n') AS le FROM probs)""",
    "probs",
)
