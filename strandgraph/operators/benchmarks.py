"""Benchmark prompts, joins and scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import scoring as s
from strandgraph.functions import text as t
from strandgraph.operators.ordinal import latest_by, one_per_key, with_group_ordinal

# --- fixed values ------------------------------------------------------------

# What each letter of an input layout writes. BECAUSE is followed by lecture, solution or both.
INPUT_LAYOUTS = ["CQM", "QCM", "QCML", "QCME", "QCMLE", "QCLM", "QCEM", "QCLEM"]
# The words of an output layout, in order; AL gives the solution and AE the lecture.
OUTPUT_LAYOUTS = {
    "A": "Answer: The answer is {answer}.",
    "AL": "Answer: The answer is {answer}. BECAUSE: {solution}",
    "AE": "Answer: The answer is {answer}. BECAUSE: {lecture}",
    "ALE": "Answer: The answer is {answer}. BECAUSE: {lecture} {solution}",
    "AEL": "Answer: The answer is {answer}. BECAUSE: {solution} {lecture}",
    "LA": "Answer: {lecture} The answer is {answer}.",
    "EA": "Answer: {solution} The answer is {answer}.",
    "LEA": "Answer: {lecture} {solution} The answer is {answer}.",
    "ELA": "Answer: {solution} {lecture} The answer is {answer}.",
}
LETTER_PROMPT = "Answer with the option's letter from the given choices directly."

# --- prompts -----------------------------------------------------------------


def _fill(template: str, values: dict[str, Column]) -> Column:
    """A text with {name} places as one concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def input_template(layout: str) -> str:
    """The text of an input layout: question, context, options and reasons in the layout's order."""
    if layout not in INPUT_LAYOUTS:
        raise ValueError(f"unknown input layout: {layout}")
    reasons = {"L": "{lecture}", "E": "{solution}"}
    rows = {"Q": "Question: {question}\n", "C": "Context: {context}\n", "M": "Options: {choice}\n"}
    out, because = "", []
    for letter in layout + ".":
        if letter in reasons:
            because.append(reasons[letter])
            continue
        if because:
            out += "BECAUSE: " + " ".join(because) + "\n"
            because = []
        out += rows.get(letter, "")
    return out


def _tidy(c: Column) -> Column:
    squeezed = t.strip(F.replace(c, F.lit("  "), F.lit(" ")))
    return F.when(squeezed.endswith("BECAUSE:"), t.strip(F.replace(squeezed, F.lit("BECAUSE:"), F.lit("")))).otherwise(squeezed)


def _problem_values(use_caption: bool, options: Sequence[str]) -> dict[str, Column]:
    letters = F.array(*[F.lit(o) for o in options])
    context = t.strip(F.concat_ws(" ", F.coalesce("hint", F.lit("")), F.coalesce("caption", F.lit("")) if use_caption else F.lit("")))
    choice = F.array_join(F.transform("choices", lambda c, i: t.concat("(", letters[i], ") ", c)), " ")
    return {
        "question": F.col("question"),
        "context": F.when(context == "", "N/A").otherwise(context),
        "choice": choice,
        "answer": letters[F.col("answer")],
        "lecture": F.replace("lecture", F.lit("\n"), F.lit("\\n")),
        "solution": F.replace("solution", F.lit("\n"), F.lit("\\n")),
    }


def mcq_prompt(
    problems: DataFrame, layout: str, test: bool = False, use_caption: bool = False, options: Sequence[str] = tuple(s.OPTIONS)
) -> DataFrame:
    """problems(id, question, hint, caption, choices, answer, lecture, solution) + input, output, block.

    ``block`` is the input and the output as one text. ``layout`` is INPUT-OUTPUT, e.g. QCM-LEA. With ``test`` the output is the open ``Answer:``.
    """
    given, wanted = layout.split("-")
    values = _problem_values(use_caption, options)
    if test:
        output = F.lit("Answer:")
    elif wanted == "LEPA":
        output = F.concat(
            F.when(t.strip(values["lecture"]) != "", t.concat("LECTURE: ", values["lecture"], "\n")).otherwise(""),
            F.when(t.strip(values["solution"]) != "", t.concat("SOLUTION: ", values["solution"], "\n")).otherwise(""),
            t.concat("###\nANSWER: ", values["answer"], "."),
        )
    else:
        output = _fill(OUTPUT_LAYOUTS[wanted], values)
    asked = _fill(input_template(given), values)
    return problems.select(
        "*", _tidy(asked).alias("input"), _tidy(output).alias("output"), _tidy(F.concat(asked, output)).alias("block")
    )


def few_shot(problems: DataFrame, shots: DataFrame, layout: str, chat: bool = False) -> DataFrame:
    """problems(id, ...) and the ordered examples shots(ord, ...) -> id, prompt.

    Example blocks and then the test item, separated by blank lines. ``chat`` gives
    messages ARRAY<STRUCT<role, content>> with a leading system message instead.
    The shots are the few examples shown with every item; they are folded into one value.
    """
    shown = mcq_prompt(shots, layout)
    asked = mcq_prompt(problems, layout, test=True)
    if not chat:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda e: e["block"])
        examples = shown.agg(listed).scalar()
        return asked.select("id", F.array_join(F.concat(examples, F.array("block")), "\n\n").alias("prompt"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    pair = F.array(message("user", F.col("input")), message("assistant", F.col("output")))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", pair.alias("p")))), lambda e: e["p"]))
    examples = shown.agg(listed).scalar()
    head = F.array(message("system", F.lit("You are a helpful assistant.")))
    return asked.select("id", F.concat(head, examples, pair).alias("messages"))


def mcq_conversations(problems: DataFrame, layout: str) -> DataFrame:
    """id, image, instruction, output; the image mark follows the text when there is an image."""
    made = mcq_prompt(problems, layout)

    def without(c: str, prefix: str) -> Column:
        return F.when(F.col(c).startswith(prefix), F.replace(c, F.lit(prefix), F.lit(""))).otherwise(F.col(c))

    text = without("input", "Question: ")
    has_image = F.col("image").isNotNull()
    return made.select(
        "id",
        F.when(has_image, t.concat(F.col("id").cast("string"), "/", F.col("image"))).alias("image"),
        F.when(has_image, t.concat(text, "\n<image>")).otherwise(text).alias("instruction"),
        without("output", "Answer: ").alias("output"),
    )


def review_prompt(
    questions: DataFrame,
    first: DataFrame,
    second: DataFrame,
    rules: DataFrame,
    fallback: str | None = "default",
    category_prefix: str = "",
    context: DataFrame | None = None,
) -> DataFrame:
    """questions(question_id, text, category, image?), answers(question_id, text), rules(category, role, prompt) -> question_id, category, content.

    An unknown category takes the ``fallback`` rule, or is an error without one.
    ``context`` (image, captions ARRAY, boxes ARRAY?) puts captions and boxes in front.
    """
    asked = questions.withColumn("_cat", t.concat(category_prefix, F.col("category")))
    one = first.select("question_id", F.col("text").alias("_a1"))
    two = second.select("question_id", F.col("text").alias("_a2"))
    table = rules.select(F.col("category").alias("_cat"), F.col("role").alias("_role"), F.col("prompt").alias("_prompt"))
    joined = asked.join(one, "question_id").join(two, "question_id").join(table, "_cat", "left")
    missing = F.col("_role").isNull()
    if fallback is not None:
        chosen = rules.where(F.col("category") == fallback)
        role = F.when(missing, chosen.select("role").scalar()).otherwise(F.col("_role"))
        prompt = F.when(missing, chosen.select("prompt").scalar()).otherwise(F.col("_prompt"))
    else:
        failed = F.raise_error(t.concat("no rule for category ", F.col("_cat"))).cast("string")
        role, prompt = F.when(missing, failed).otherwise(F.col("_role")), F.col("_prompt")
    head = F.lit("")
    if context is not None:
        joined = joined.join(context, "image")
        shown = [F.array_join("captions", "\n")] + ([F.array_join("boxes", "\n")] if "boxes" in context.columns else [])
        head = t.concat("[Context]\n", F.concat_ws("\n\n", *shown), "\n\n")
    joined = joined.withColumn("_r", role).withColumn("_p", prompt)

    def answer(n: int) -> Column:
        return t.concat("[", F.col("_r"), f" {n}]\n", F.col(f"_a{n}"), "\n\n[End of ", F.col("_r"), f" {n}]\n\n")

    content = t.concat(head, "[Question]\n", F.col("text"), "\n\n", answer(1), answer(2), "[System]\n", F.col("_p"), "\n\n")
    return joined.select("question_id", "category", content.alias("content"))


def option_rounds(
    rows: DataFrame, all_rounds: bool = True, letters: Sequence[str] = ("A", "B", "C", "D"), ask_letter: bool = False
) -> DataFrame:
    """rows(index, question, hint, A, B, C, D) -> question_id, round_id, prompt, options, option_char.

    Options end at the first missing one. Every round rotates them by one; the prompt
    always labels them A, B, ... while ``option_char`` keeps the original letters.
    ``ask_letter`` ends the prompt with the request for the letter alone.
    """

    def missing(c: Column) -> Column:
        return c.isNull() | F.lower(c).isin("nan", "none")

    stops = F.array(*[missing(F.col(x)) for x in letters])
    count = F.array_position(stops, F.lit(True)).cast("int")
    n = F.when(count == 0, len(letters)).otherwise(count - 1)
    rotations = F.when(F.col("_n") > 0, F.sequence(F.lit(0), (F.col("_n") - 1) if all_rounds else F.lit(0)))

    def rotate(items: str) -> Column:
        return F.concat(F.slice(items, F.col("round_id") + 1, F.col("_n")), F.slice(items, F.lit(1), F.col("round_id")))

    labels = F.array(*[F.lit(x) for x in letters])
    base = (
        rows.withColumn("_n", n)
        .withColumn("_o", F.slice(F.array(*letters), F.lit(1), F.col("_n")))
        .withColumn("_l", F.slice(labels, F.lit(1), F.col("_n")))
        .withColumn("round_id", F.explode(rotations))
        .withColumn("options", rotate("_o"))
        .withColumn("option_char", rotate("_l"))
    )
    asked = F.when(missing(F.col("hint")), F.col("question")).otherwise(t.concat(F.col("hint"), "\n", F.col("question")))
    listed = F.transform("options", lambda o, i: t.concat("\n", labels[i], ". ", o))
    request = F.lit("\n" + LETTER_PROMPT if ask_letter else "")
    return base.select(
        F.col("index").alias("question_id"), "round_id", F.concat(asked, F.array_join(listed, ""), request).alias("prompt"), "options", "option_char"
    )


# --- joins -------------------------------------------------------------------


def align_variants(variants: dict[str, tuple[DataFrame, DataFrame]], order: str | None = None) -> DataFrame:
    """{name: (data(question_id, image, question, reference), answers(question_id, text))} -> image, question, reference, variants MAP<name, text>, is_complete, texts_match.

    Sorted by image and question. Within a variant the last question id of a key
    counts, and of a question the last answer under ``order`` (without it a repeated
    question is an error). Three missing texts match.
    """
    parts = []
    for name, (data, answers) in variants.items():
        texts = one_per_key(answers, ["question_id"], order).select("question_id", F.col("text").alias("_text"))
        parts.append(
            data.join(texts, "question_id", "left").select("image", "question", "reference", "question_id", F.lit(name).alias("_v"), "_text")
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    slots = [
        F.max_by(F.struct(F.col("_text").alias("text")), F.when(F.col("_v") == name, F.col("question_id"))).alias(f"_s{i}")
        for i, name in enumerate(variants)
    ]
    grouped = every.groupBy("image", "question", "reference").agg(*slots)
    complete, same = F.lit(True), F.lit(True)
    for i in range(len(variants)):
        complete = complete & F.col(f"_s{i}").isNotNull()
        same = same & F.col("_s0.text").eqNullSafe(F.col(f"_s{i}.text"))
    pairs = [F.struct(F.lit(name).alias("key"), F.col(f"_s{i}.text").alias("value"), F.col(f"_s{i}").isNotNull().alias("has")) for i, name in enumerate(variants)]
    present = F.filter(F.array(*pairs), lambda p: p["has"])
    table = F.map_from_entries(F.transform(present, lambda p: F.struct(p["key"], p["value"])))
    out = grouped.select("image", "question", "reference", table.alias("variants"), complete.alias("is_complete"), (complete & same).alias("texts_match"))
    return out.orderBy("image", "question", "reference")


def resume_skip(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Questions without a review yet."""
    return questions.join(reviews.select("question_id").distinct(), "question_id", "left_anti")


def table_review(questions: DataFrame, answers: dict[str, DataFrame], review: DataFrame) -> DataFrame:
    """questions(question_id, category, text), answers {name: (question_id, text)}, review(question_id, content, tuple) -> id, category, question, answers..., evaluation, score, with the fixed renumbering."""
    out = questions.withColumnRenamed("text", "question")
    for name, table in answers.items():
        out = out.join(table.select("question_id", F.col("text").alias(name)), "question_id")
    out = out.join(review.select("question_id", s.clean_review("content").alias("evaluation"), F.col("tuple").alias("score")), "question_id")
    q = F.col("question_id")
    one = F.when(q <= 20, q + 60).otherwise(q - 20)
    two = s.let(one, lambda x: F.when(x <= 50, x + 10).when(x <= 60, x - 50).otherwise(x))
    three = s.let(two, lambda x: F.when(x == 7, F.lit(1).cast("long")).when(x < 7, x + 1).otherwise(x))
    return out.select(three.alias("id"), "category", "question", *answers, "evaluation", "score")


def pope_pairs(answers: DataFrame, questions: DataFrame, labels: DataFrame) -> DataFrame:
    """answers(question_id, text), questions(question_id, category), labels(category, label, ord) -> category, pred, label.

    Inside a category the answers (by question id) and the labels (by ord) meet by position.
    """
    asked = answers.join(questions.select("question_id", "category"), "question_id")
    mine = with_group_ordinal(asked, ["category"], ["question_id"], "_pos").select("category", "_pos", s.pope_yes_no("text").alias("pred"))
    theirs = with_group_ordinal(labels.select("category", "label", "ord"), ["category"], ["ord"], "_pos").select("category", "_pos", "label")
    return mine.join(theirs, ["category", "_pos"]).select("category", "pred", "label")


# --- scores ------------------------------------------------------------------


def confusion(df: DataFrame, pred: Column, label: Column, by: str) -> DataFrame:
    """by, tp, fp, tn, fn, accuracy, precision, recall, f1, yes_ratio; pred and label are booleans; no division by zero."""
    counted = df.groupBy(by).agg(
        F.count_if(pred & label).alias("tp"),
        F.count_if(pred & ~label).alias("fp"),
        F.count_if(~pred & ~label).alias("tn"),
        F.count_if(~pred & label).alias("fn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    scored = counted.select(
        "*",
        F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("tp") + F.col("fp"), total).alias("yes_ratio"),
    )
    return scored.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(df: DataFrame, correct: Column, by: str, total: str = "all") -> DataFrame:
    """by, n, correct, pct per group and for all rows (named ``total``), in one pass."""
    counted = df.rollup(by).agg(
        F.grouping(by).alias("_total"), F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct")
    )
    name = F.when(F.col("_total") == 1, total).otherwise(F.col(by).cast("string"))
    return counted.select(name.alias(by), "n", "correct", F.round(100 * F.try_divide("correct", "n"), 2).alias("pct"))


def seed_accuracy(questions: DataFrame, results: DataFrame, data_type: str | None = None, order: str | None = None) -> DataFrame:
    """questions(question_id, question_type_id, data_type, answer), results(question_id, text): accuracy per type and total.

    Ids may be numbers or text on either side; an unanswered question stays in the count.
    The last result of a question under ``order`` counts; without it a repeat is an error.
    """
    asked = questions if data_type is None else questions.where(F.col("data_type") == data_type)
    named = results.withColumn("_id", F.col("question_id").cast("string"))
    answers = one_per_key(named, ["_id"], order).select("_id", F.col("text").alias("_text"))
    joined = asked.join(answers, F.col("question_id").cast("string") == F.col("_id"), "left")
    return accuracy(joined, F.coalesce(F.col("_text") == F.col("answer"), F.lit(False)), "question_type_id")


def mcq_accuracy(problems: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """problems(id, choices, answer), predictions(id, text, prompt): one row with overall and image-subset accuracy.

    A missing prediction is FAILED and counts as wrong. The last prediction of a problem
    under ``order`` counts; without it a repeat is an error.
    """
    found = one_per_key(predictions, ["id"], order).select("id", F.col("text").alias("_text"), F.col("prompt").alias("_prompt"))
    joined = problems.join(found, "id", "left")
    letter = s.mcq_letter(F.coalesce("_text", F.lit("FAILED")))
    right = s.option_index(letter, F.size("choices")) == F.col("answer")
    image = F.coalesce(F.col("_prompt").contains("<image>"), F.lit(False))
    out = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(right).alias("correct"),
        F.count_if(image).alias("image_total"),
        F.count_if(image & right).alias("image_correct"),
    )
    return out.select(
        "*",
        F.round(100 * F.try_divide("correct", "total"), 2).alias("pct"),
        F.round(100 * F.try_divide("image_correct", "image_total"), 2).alias("image_pct"),
    )


def ensemble(
    problems: DataFrame, ours: DataFrame, partner: DataFrame, requery: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """problems(id, choices, answer), ours/partner/requery(id, text): one row of counts.

    A partner that states no answer falls back to ours; the upper bound counts either
    one right. An unreadable answer is index -1, never a guess. With ``requery`` its
    answer replaces ours where it states one. The last answer of a problem under
    ``order`` counts; without it a repeat is an error.
    """
    ours, partner = one_per_key(ours, ["id"], order), one_per_key(partner, ["id"], order)
    joined = problems.join(ours.select("id", F.col("text").alias("_o")), "id").join(partner.select("id", F.col("text").alias("_p")), "id")
    if requery is not None:
        joined = joined.join(one_per_key(requery, ["id"], order).select("id", F.col("text").alias("_q")), "id", "left")
    n = F.size("choices")
    staged = joined.select(
        "answer",
        s.option_index(s.stated_letter("_o"), n).alias("o"),
        s.option_index(s.stated_letter("_p"), n).alias("p"),
        (s.stated_letter("_p") == "FAILED").alias("failed"),
        *(
            []
            if requery is None
            else [
                s.option_index(s.stated_letter(F.coalesce("_q", F.lit("MISSING"))), n).alias("q"),
                (s.stated_letter(F.coalesce("_q", F.lit("MISSING"))) == "FAILED").alias("q_failed"),
                F.col("_q").isNull().alias("q_missing"),
            ]
        ),
    )
    o, p = F.col("o") == F.col("answer"), F.col("p") == F.col("answer")
    final = F.when(F.col("failed"), o).otherwise(p)
    counts = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(final).alias("correct"),
        # A failed partner has taken over our answer, so either one right is ours or the final one.
        F.count_if(o | final).alias("correct_upperbound"),
        F.count_if("failed").alias("partner_failed"),
        F.count_if(o).alias("our_correct"),
        F.count_if(p).alias("partner_correct"),
    ]
    if requery is not None:
        again = F.when(F.col("q_failed"), o).otherwise(F.col("q") == F.col("answer"))
        counts += [F.count_if(again).alias("requery_correct"), F.count_if("q_missing").alias("missing_requery")]
    return staged.agg(*counts)


def soft_vqa_rows(df: DataFrame) -> DataFrame:
    """df(id, pred, answers ARRAY of 10) -> id, score.

    Every answer is scored by the mean over annotators of min(1, matching others / 3).
    """
    normalized = df.select("id", s.evalai_normalize("pred").alias("p"), F.transform("answers", lambda a: s.evalai_normalize(a)).alias("a"))
    c = F.size(F.filter("a", lambda x: x == F.col("p")))
    score = (c * F.least(F.lit(1.0), (c - 1) / 3) + (10 - c) * F.least(F.lit(1.0), c / 3)) / 10
    checked = F.when(F.size("a") != 10, F.raise_error(F.lit("ten answers expected")).cast("double"))
    return normalized.select("id", checked.otherwise(F.when(c > 0, score).otherwise(F.lit(0.0))).alias("score"))


def st_vqa_rows(df: DataFrame) -> DataFrame:
    """df(id, pred, answers) -> id, accuracy (any normalised match), anls."""
    normalized = df.select(
        "id", "pred", "answers", s.evalai_normalize("pred").alias("p"), F.transform("answers", lambda a: s.evalai_normalize(a)).alias("a")
    )
    match = F.array_contains("a", F.col("p"))
    return normalized.select(
        "id", F.when(match, F.lit(1.0)).otherwise(F.lit(0.0)).alias("accuracy"), s.anls("pred", "answers").alias("anls")
    )


def textvqa_join(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """annotations(image_id, question, answers), results(question_id = image id, prompt, text) -> id, pred, answers."""
    asked = results.select(F.col("question_id").alias("image_id"), s.textvqa_question("prompt").alias("_q"), F.col("text").alias("pred"))
    known = latest_by(annotations.select("image_id", F.lower("question").alias("_q"), "answers").withColumn("_o", F.size("answers")), ["image_id", "_q"], "_o")
    return asked.join(known, ["image_id", "_q"]).select(F.col("image_id").alias("id"), "pred", "answers")


def review_summary(reviews: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """reviews(question_id, category, tuple, score) -> category, ratio, first, second, per category and for ``all``.

    Means are rounded to three digits before the ratio; rows without category count in ``all`` only.
    """
    kept = reviews.where(~F.col("question_id").isin(list(ignore))) if ignore else reviews
    pair = F.coalesce("tuple", "score")
    named = kept.select(F.explode(F.array_compact(F.array(F.col("category"), F.lit("all")))).alias("category"), pair[0].alias("_a"), pair[1].alias("_b"))
    means = named.groupBy("category").agg(F.round(F.avg("_a"), 3).alias("_a"), F.round(F.avg("_b"), 3).alias("_b"))
    return means.select(
        "category",
        F.round(F.try_divide("_b", "_a") * 100, 1).alias("ratio"),
        F.round(F.col("_a") * 10, 1).alias("first"),
        F.round(F.col("_b") * 10, 1).alias("second"),
    )


def judge_summary(replies: DataFrame, dims: Sequence[str] = tuple(s.JUDGE_DIMS)) -> DataFrame:
    """replies(id, text) -> the rounded mean per dimension, overall (mean of the rounded means), num_scored, num_samples."""
    scored = replies.select(s.parse_judge("text", dims).alias("_s"))
    means = scored.agg(
        *[F.coalesce(F.round(F.avg(f"_s.{d}"), 2), F.lit(0.0)).alias(d) for d in dims],
        F.count("_s").alias("num_scored"),
        F.count(F.lit(1)).alias("num_samples"),
    )
    overall = sum((F.col(d) for d in dims[1:]), F.col(dims[0])) / len(dims)
    return means.withColumn("overall", F.round(overall, 2))


# --- submissions -------------------------------------------------------------


def to_submission(df: DataFrame, kind: str) -> DataFrame:
    """df(question_id, text, ...) in the form a benchmark takes.

    gqa: questionId, prediction. mmvet: key, text (an object when written).
    vqa: question_id, answer. vizwiz: image, answer. mmbench: the annotation columns and prediction.
    """
    if kind == "gqa":
        return df.select(F.col("question_id").alias("questionId"), s.gqa_normalize("text").alias("prediction"))
    if kind == "mmvet":
        return df.select(t.concat("v1_", F.col("question_id").cast("string")).alias("key"), "text")
    if kind == "vqa":
        return df.select("question_id", s.evalai_normalize("text").alias("answer"))
    if kind == "vizwiz":
        return df.select("image", s.evalai_normalize("text").alias("answer"))
    if kind == "mmbench":
        dropped = ["hint", "category", "source", "image", "comment", "l2-category"]
        return df.drop(*[c for c in dropped if c in df.columns]).withColumnRenamed("text", "prediction")
    raise ValueError(f"unknown submission: {kind}")


def submission_join(questions: DataFrame, results: DataFrame, required: bool = False, order: str | None = None) -> DataFrame:
    """questions(question_id, ...) with their result text; a missing one is empty, or an error when ``required``.

    The last result of a question under ``order`` counts; without it a repeat is an error.
    """
    found = one_per_key(results, ["question_id"], order).select("question_id", F.col("text").alias("_text"))
    joined = questions.join(found, "question_id", "left")
    missing = F.raise_error(t.concat("no result for question ", F.col("question_id").cast("string"))).cast("string") if required else F.lit("")
    return joined.withColumn("text", F.coalesce("_text", missing)).drop("_text")
