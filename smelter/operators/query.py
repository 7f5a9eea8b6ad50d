"""Questions over gold: metric queries, the value dictionary, and routing of question texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col, quoted
from ..functions.numbers import round_metric
from ..plans.metric import Metric, aggregation_class, metric_column, metric_definition_text
from ..session import durable, small_frame

# Words that ask for a breakdown, a ranking, or a ranking from below.
BREAKDOWN_WORDS = ("by ", "per ", "across ", "for each ", "grouped by ", "breakdown", "break down")
TOP_WORDS = ("top ", "best ", "highest ", "most ")
BOTTOM_WORDS = ("bottom ", "worst ", "lowest ", "least ")
DEFAULT_LIMIT = 10
#: Value tables up to so many rows and bytes are sent to every task; larger ones are met in a shuffle, off the driver.
FEW_VALUES, FEW_BYTES = 20_000, 4 << 20


def metric_query(fact: DataFrame, metric: Metric, breakdown: str | None = None,
                 filters: Sequence[tuple[str, object]] = (), order: str = "desc",
                 limit: int | None = DEFAULT_LIMIT, rounded: bool = False) -> DataFrame:
    """One metric, in total or by a dimension: filtered, ranked, cut to ``limit`` rows (breakdowns only).

    Equal values are ranked by the dimension, so the result is repeatable. ``limit=None`` keeps all rows.
    """
    rows = fact
    for dim, value in filters:
        rows = rows.where(col(dim) == F.lit(value))
    value = metric_column(metric)
    if breakdown is None:
        answer = rows.agg(value)
    else:
        answer = rows.groupBy(col(breakdown)).agg(value)
    if rounded:
        answer = answer.withColumn(metric.metric, round_metric(col(metric.metric), metric.round))
    if breakdown is None:
        return answer
    ranked = answer.orderBy(col(metric.metric).asc() if order == "asc" else col(metric.metric).desc(),
                            col(breakdown).asc())
    return ranked if limit is None else ranked.limit(limit)


def value_rows(facts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(dim, value): every distinct value of each dimension, as text. No value is left out."""
    lists = [fact.select(*[col(d).cast("string").alias(d) for d in dims])
             .unpivot([], [quoted(d) for d in dims], "dim", "value").where(F.col("value").isNotNull()).distinct()
             for fact, dims in facts if dims]
    return reduce(DataFrame.unionByName, lists).distinct()


def dim_values(facts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(dim, values): the distinct values of each dimension as sorted text, for readers. Routing joins ``value_rows``,
    so a dimension of very many values is never gathered for it."""
    return value_rows(facts).groupBy("dim").agg(F.array_sort(F.collect_set("value")).alias("values"))


# --- routing -----------------------------------------------------------------

def _phrase(text: Column) -> Column:
    """Lower case words between single spaces, so that a phrase matches whole words only."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def _phrase_literal(text: str) -> str:
    return " " + re.sub(r"[^\w]+", " ", text.lower()).strip() + " "


def _has_any(question: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [question.contains(w) for w in words])


def _longest(question: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Id of the longest term that occurs in the question; of equally long terms the first listed."""
    ranked = sorted((t for t in terms if t[0]), key=lambda t: -len(t[0]))
    if not ranked:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(question.contains(term), F.lit(ident)) for term, ident in ranked])


def _grams(text: Column, longest: Column, whole_words: bool) -> Column:
    """All runs of up to ``longest`` words (or characters) of a normalised text."""
    parts = F.split(F.trim(text), " ") if whole_words else F.split(text, "")
    joint = " " if whole_words else ""

    def runs(p: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(longest, F.size(p) - i + 1)), lambda n: F.array_join(F.slice(p, i, n), joint))))
    return F.array_distinct(runs(parts))


def _named_values(texts: DataFrame, values: DataFrame, whole_words: bool) -> DataFrame:
    """(_text, filters): for each different question text, the first value by order of each dimension that it names.

    An equi-join of the text's word runs with the value table: neither side comes to the driver, and a dimension may
    have any number of values.
    """
    spelled = values.select("dim", "value", (F.trim(_phrase(F.col("value"))) if whole_words else F.lower("value")).alias("_gram"))
    spelled = durable(spelled.where("_gram <> ''"))  # read twice: the value table is worked out once
    size = F.size(F.split("_gram", " ")) if whole_words else F.char_length("_gram")
    longest, number, weight = spelled.agg(F.coalesce(F.max(size), F.lit(1)), F.count(F.lit(1)), F.coalesce(F.sum(
        F.octet_length("_gram") + F.octet_length("value")), F.lit(0))).first()
    grams = texts.select("_text", F.explode(_grams(F.col("_text"), F.lit(longest), whole_words)).alias("_gram"))
    # Names compress well: by the bytes of its shuffle, a table that fills the driver's memory would seem small.
    spelled = F.broadcast(spelled) if number <= FEW_VALUES and weight <= FEW_BYTES else spelled.hint("merge")
    return (grams.join(spelled, "_gram").groupBy("_text", "dim").agg(F.min("value").alias("value"))
            .groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_found")))


def route_questions(questions: DataFrame, metrics: Sequence[Metric], dims: Sequence[str],
                    values: DataFrame | Mapping[str, Sequence[str]], question: str = "question",
                    whole_words: bool = True) -> DataFrame:
    """Add the plan of each question: metric, breakdown, filters, order, limit, and what it leaves ``unresolved``.

    Metric ids, labels and dimension names are metadata and become part of the expressions; ``values`` (dim, value)
    is data and is joined. ``whole_words=False`` lets a value match inside a longer word. A question that asks "for"
    something that is no known value, metric or dimension is not ``answered``: a total over all rows would not be what
    was asked for. A number that is no integer of Spark's asks for no limit.
    """
    if not isinstance(values, DataFrame):
        pairs = [(d, v) for d, vs in values.items() for v in vs]
        values = small_frame(questions.sparkSession, pairs, "dim string, value string")
    q = F.col("_q")
    terms = [(t.lower().strip(), m.metric) for m in metrics for t in (m.metric, m.label or "")]
    asks_breakdown = _has_any(q, BREAKDOWN_WORDS + TOP_WORDS + BOTTOM_WORDS)
    breakdown = F.when(asks_breakdown, _longest(q, [(d.lower(), d) for d in dims]))
    asked = F.nullif(F.regexp_extract(q, r"(top|bottom)\s+(\d+)", 2), F.lit("")).try_cast("int")
    wanted = F.nullif(F.trim(F.regexp_extract(q, r"\bfor\s+(?!each\b)([^?]*)", 1)), F.lit(""))
    known = [w for w in {t for t, _ in terms} | {d.lower() for d in dims} if w]
    names_known = _has_any(_phrase(F.col("_wanted")), [_phrase_literal(w) for w in known]) if known else F.lit(False)
    routed = questions.withColumns({
        "_q": F.lower(col(question)), "_text": _phrase(col(question)) if whole_words else F.lower(col(question))})
    found = _named_values(routed.select("_text").distinct(), values, whole_words)
    routed = routed.join(found.hint("merge"), "_text", "left").withColumns({  # up to a row a question: not for the driver
        "metric": _longest(q, terms), "breakdown": breakdown, "_asked": asked, "_wanted": wanted,
        "order": F.when(_has_any(q, BOTTOM_WORDS), "asc").otherwise("desc"),
        "filters": F.coalesce("_found", F.from_json(F.lit("[]"), "array<struct<dim:string,value:string>>"))})
    unresolved = F.when((F.size("filters") == 0) & ~names_known, F.col("_wanted"))
    return routed.select(
        *[col(c) for c in questions.columns], "metric", "breakdown", "filters", "order",
        F.coalesce(F.nullif("_asked", F.lit(0)), F.when(F.col("breakdown").isNotNull(), DEFAULT_LIMIT)).alias("limit"),
        (F.col("metric").isNotNull() & unresolved.isNull()).alias("answered"), unresolved.alias("unresolved"))


RECEIPT_SCHEMA = """
    question_no int, question string, answered boolean, metric string, description string, owner string,
    version string, aggregation string, class string, lineage array<string>, definition string, breakdown string,
    filters array<struct<dim:string,value:string>>, order string, limit int, note string
"""


def receipts(spark: SparkSession, plans: Sequence, metrics: Sequence[Metric]) -> DataFrame:
    """One receipt per question: what was computed, from what, under which definition and version."""
    by_id = {m.metric: m for m in metrics}
    rows = []
    for number, plan in enumerate(plans, start=1):
        m = by_id.get(plan["metric"]) if plan["answered"] else None
        if m is None:
            rows.append((number, plan["question"], False) + (None,) * 12 + (plan["unresolved"] and f"no value named {plan['unresolved']}",))
            continue
        recomputed = aggregation_class(m.aggregation) == "ratio-like"
        rows.append((number, plan["question"], True, m.metric, m.description, m.owner, m.version, m.aggregation,
                     aggregation_class(m.aggregation), list(m.lineage), metric_definition_text(m), plan["breakdown"],
                     plan["filters"], plan["order"], plan["limit"],
                     "ratio recomputed from components" if recomputed else "additive"))
    return small_frame(spark, rows, RECEIPT_SCHEMA)


def answer_questions(spark: SparkSession, facts: Mapping[str, tuple[DataFrame, Sequence[str]]],
                     metrics: Sequence[Metric], questions: Sequence[str]
                     ) -> tuple[dict[int, DataFrame], DataFrame]:
    """Answer a list of questions: a lazy result per answered question (by number), and the receipts.

    ``facts`` maps a fact name to its rows and its dimensions. A breakdown or filter on a dimension that the
    metric's fact does not have is left out of that question's plan.
    """
    dims = sorted({d for _, ds in facts.values() for d in ds})
    known = value_rows(list(facts.values())) if dims else {}
    asked = small_frame(spark, list(enumerate(questions, start=1)), "question_no int, question string")
    by_id = {m.metric: m for m in metrics}
    plans, answers = [], {}
    for row in route_questions(asked, metrics, dims, known).orderBy("question_no").collect():
        plan = row.asDict(recursive=True)
        metric = by_id.get(plan["metric"]) if plan["answered"] else None
        if metric is not None:
            fact, own = facts[metric.fact]
            plan["breakdown"] = plan["breakdown"] if plan["breakdown"] in own else None
            plan["limit"] = plan["limit"] if plan["breakdown"] else None
            plan["filters"] = [f for f in plan["filters"] if f["dim"] in own]
            conditions = [(f["dim"], f["value"]) for f in plan["filters"]]
            answers[plan["question_no"]] = metric_query(fact, metric, plan["breakdown"], conditions, plan["order"],
                                                        plan["limit"])
        plans.append(plan)
    return answers, receipts(spark, plans, metrics)


__all__ = ["answer_questions", "dim_values", "metric_query", "receipts", "route_questions", "value_rows"]
