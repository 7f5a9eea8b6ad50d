"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always stay. Beside them,
generators with high recall propose further spans, which may overlap. The trees learn from the proposals of all
documents but one in so many how format and context tell personal data, and a threshold per kind is set on those others. A proposal is positive if a base rule confirms it or its format and cue do, whatever base rules say;
plausible ones that nothing confirms teach nothing. A prior of made-up lines whose spans are known joins both parts, so
that trees and thresholds are there on small tables too. Every span beyond the base rules' has reached the threshold of
its kind. Everything is SQL expressions over one row: no shuffle, no Python.

Patterns are written so that a match never backtracks into what it has read: a very long run costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, small_frame
from . import boosting
from .common import let

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive quantifiers and look-behinds only spare the engine work; the matches are
# those of the plain patterns, leftmost and not overlapping.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What proposes more spans of a kind.
PROPOSED = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}
#: A text without these can hold no span of the kind.
GUARDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ .-]?[0-9]){11}", "phone": r"[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]"}
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|addr|server", "card": r"(?i)card|visa|pay|credit|account",
        "phone": r"(?i)tel|phone|call|fax|mobile|contact"}
#: One document in so many sets the thresholds; the trees learn from the others.
CALIBRATION_EVERY = 4
LEAST_PRECISION, LEAST_CONFIRMED = 0.98, 20
#: Positive and negative made-up lines a kind; half of them train, half calibrate.
PRIOR_LINES = 48
_CONTEXT = 24
_STEP = 128
_SPAN = "array<struct<kind:int,start:long,end:long,hit:string,left:string,right:string>>"


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each position, in chunks: the copying grows with the square of a chunk only."""
    def sums(values: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")),
                         lambda c: sums(F.slice(lengths, c * _STEP + 1, F.lit(_STEP))))

    def shifted(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda part: F.element_at(part, -1)))
        return let(before, lambda offsets: F.flatten(F.transform(parts, lambda part, i: F.transform(
            F.slice(part, 1, F.size(part) - 1), lambda v: v + F.element_at(offsets, i + 1)))))
    return let(chunks, shifted)


def _spans(text: Column, kind: str, pattern: str, accept=None) -> Column:
    """Every match of a pattern with its place in code points and the text around it."""
    number = KINDS.index(kind)
    hits = F.when(F.rlike(text, F.lit(GUARDS[kind])), F.regexp_extract_all(text, F.lit(pattern), 0))

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def with_gaps(g: Column) -> Column:
            pairs = F.transform(found, lambda h, i: (F.char_length(F.element_at(g, i + 1)) + F.char_length(h)).cast("long"))
            return let(_running(pairs), lambda before: F.transform(found, lambda h, i: let(
                F.element_at(before, i + 1) + F.char_length(F.element_at(g, i + 1)), lambda start: F.struct(
                    F.lit(number).alias("kind"), start.alias("start"), (start + F.char_length(h)).alias("end"), h.alias("hit"),
                    F.right(F.element_at(g, i + 1), F.lit(_CONTEXT)).alias("left"),
                    F.left(F.element_at(g, i + 2), F.lit(_CONTEXT)).alias("right")))))
        return let(gaps, with_gaps)
    none = F.from_json(F.lit("[]"), _SPAN)
    spans = let(hits, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))
    return F.filter(spans, lambda s: accept(s["hit"])) if accept else spans


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    doubled = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + let(
        F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
        lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return (n > 0) & (doubled % 10 == 0)


def _between(low: int, high: int):
    return lambda hit: let(F.char_length(_digits(hit)), lambda n: n.between(low, high))


def _card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))


def _quad(hit: Column) -> Column:
    return F.rlike(hit, F.lit(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"))


#: What a proposal must meet to be one at all: four parts beyond 255 are no address, whatever stands around them.
POSSIBLE = {"ip": _quad}
ACCEPT = {"email": None, "ip": _quad, "card": _card, "phone": _between(9, 15)}


def base_spans(text: Column) -> Column:
    """All base spans, kind after kind."""
    return F.concat(*[_spans(text, kind, BASE[kind], ACCEPT[kind]) for kind in KINDS])


def proposals(text: Column) -> Column:
    return F.concat(*[_spans(text, kind, PROPOSED[kind], POSSIBLE.get(kind)) for kind in KINDS])


def _class_of(char: Column) -> Column:
    return (F.when(char == "", 0).when(F.rlike(char, F.lit(r"\s")), 1).when(F.rlike(char, F.lit(r"\p{L}")), 2)
            .when(F.rlike(char, F.lit(r"[0-9]")), 3).otherwise(4))


def features(span: Column) -> Column:
    """Format and context of a proposal, as small integers."""
    hit, digits = span["hit"], _digits(span["hit"])
    cue = F.lit(False)
    for number, kind in enumerate(KINDS):
        cue = cue | ((span["kind"] == number) & F.rlike(span["left"], F.lit(CUES[kind])))
    columns = [
        span["kind"], F.char_length(digits), F.char_length(hit), F.left(digits, F.lit(1)).try_cast("int"),
        F.startswith(hit, F.lit("+")).cast("int"), F.regexp_count(hit, F.lit(r"[()]")), F.regexp_count(hit, F.lit(r"[ .-]")),
        F.regexp_count(hit, F.lit(r"[0-9]+")), let(digits, _luhn).cast("int"), _quad(hit).cast("int"),
        F.contains(hit, F.lit("@")).cast("int"), F.char_length(F.regexp_extract(hit, r"[A-Za-z]*$", 0)),
        _class_of(F.right(span["left"], F.lit(1))), _class_of(F.left(span["right"], F.lit(1))), cue.cast("int"),
        F.regexp_count(span["left"], F.lit("[0-9]")),
    ]
    return F.array(*[F.least(F.coalesce(c.cast("int"), F.lit(0)), F.lit(boosting.MOST)) for c in columns])


def _overlaps(spans: Column, one: Column) -> Column:
    return F.exists(spans, lambda s: (s["kind"] == one["kind"]) & (s["start"] < one["end"]) & (s["end"] > one["start"]))


def _touches(spans: Column, one: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < one["end"]) & (s["end"] > one["start"]))


#: An address with (at) or [at] whose last part is letters; spaces stand around the written marks only.
_WRITTEN = (r"^[\w.%+-]+ ?[(\[]at[)\]] ?[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)*(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z]{2,}$")


def _kind(span: Column, kind: str) -> Column:
    return span["kind"] == KINDS.index(kind)


def evident(span: Column) -> Column:
    """Whether format and cue alone confirm a proposal: Luhn digits, a written-out address, a cued and parted number."""
    hit = span["hit"]
    return let(_digits(hit), lambda digits: let(F.char_length(digits), lambda n: (
        F.when(_kind(span, "card"), n.between(13, 19) & _luhn(digits))
        .when(_kind(span, "email"), F.rlike(hit, F.lit(_WRITTEN)))
        .when(_kind(span, "phone"), n.between(9, 15) & F.rlike(hit, F.lit(r"[ ().+-]")) & F.rlike(span["left"], F.lit(CUES["phone"])))
        .otherwise(False))))


def label(span: Column, base: Column) -> Column:
    """1 for a confirmed proposal, 0 for one whose format speaks against it, NULL for what may be either."""
    hit = span["hit"]
    against = (F.when(_kind(span, "card"), True).when(_kind(span, "ip"), _version(span))
               .when(_kind(span, "phone"), _touches(base, span) | ~(F.rlike(hit, F.lit(r"[ ().+-]")) | F.rlike(span["left"], F.lit(CUES["phone"]))))
               .when(_kind(span, "email"), F.contains(hit, F.lit("@")) & F.rlike(hit, F.lit(r" \.|\. ")))
               .otherwise(False))
    sure = evident(span) & (~_kind(span, "phone") | ~_touches(base, span))
    return F.when(_kind(span, "ip") & against, 0).when(_overlaps(base, span) | sure, 1).when(against, 0)


def _version(span: Column) -> Column:
    """Four numbers that are a version: more parts follow, or the word for it stands before."""
    return F.rlike(span["right"], F.lit(r"^\.[0-9]")) | F.rlike(span["left"], F.lit(r"(?i)\b(?:version|release|v) ?$"))


def _with_check_digit(digits: str) -> str:
    """The digits and the one that makes them pass Luhn's check."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def prior_lines(n: int = PRIOR_LINES) -> list[tuple[str, str, int, bool]]:
    """(text, kind, label, calibrates): n positive and n negative lines a kind, one span of the kind in each."""
    rows = []
    for i in range(n):
        a, b, c = 200 + i * 37 % 700, 100 + i * 53 % 800, 1000 + i * 7919 % 9000
        card = _with_check_digit(f"4{a}{b}{c}{a}9{i % 10}"[:15])
        wrong = card[:-1] + str((int(card[-1]) + 1 + i % 8) % 10)
        parted = f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}" if i % 3 == 0 else card
        phone = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"+{1 + i % 9} {a} {b} {c}")[i % 4]
        name, host = f"n{i}.{chr(97 + i % 26)}", f"site{i % 7}"
        mail = (f"{name}(at){host}.org", f"{name}@{host}.net", f"{name} [at] {host} [dot] com")[i % 3]
        ip = f"{10 + i}.{a % 256}.{b % 256}.{c % 256}"
        cues = {"card": ("pay by card ", "text then ", f"+1 {a} {b} {c} "), "phone": ("call ", "phone ", "tel. "),
                "email": ("write to ", "contact ", "so "), "ip": ("host ", "at ", "server ")}
        positive = {"card": parted, "phone": phone, "email": mail, "ip": ip}
        negative = {"card": wrong, "phone": f"{a}{b}{c}", "email": f"{name} @{host} . then", "ip": ip + f".{i % 10}" if i % 2 else f"{1 + i % 9}.{i % 5}.{i % 7}.{i % 3}"}
        for kind in KINDS:
            rows.append((f"{cues[kind][i % 3]}{positive[kind]} now", kind, 1, i % 2 == 0))
            before = ("version " if i % 2 == 0 else "build ") if kind == "ip" else ("no ", "total ", "of ")[i % 3]
            rows.append((f"{before}{negative[kind]} units", kind, 0, i % 2 == 0))
    return rows


def _prior(spark) -> DataFrame:
    lines = small_frame(spark, [(t, KINDS.index(k), n, c) for t, k, n, c in prior_lines()],
                        "text string, kind int, label int, calibrates boolean")
    return (lines.select("calibrates", "kind", "label", F.explode(proposals(F.col("text"))).alias("span"))
            .where("span.kind = kind").select("calibrates", "kind", features(F.col("span")).alias("features"), "label"))


@dataclass
class PiiModel:
    trees: boosting.Ensemble
    thresholds: dict[str, float]

    def selects(self, span: Column) -> Column:
        """Whether the score of a proposal reaches its kind's threshold."""
        if not self.thresholds:
            return F.lit(False)
        limit = F.lit(2.0)
        for kind, threshold in self.thresholds.items():
            limit = F.when(span["kind"] == KINDS.index(kind), threshold).otherwise(limit)
        return let(features(span), self.trees.probability) >= limit

    def added(self, text: Column, base: Column) -> Column:
        """Selected proposals that no base span of their kind touches; a phone number touches none of any kind."""
        return let(base, lambda b: F.filter(proposals(text), lambda s: ~_overlaps(b, s) & (
            ~_kind(s, "phone") | ~_touches(b, s)) & self.selects(s)))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> PiiModel:
    """Fit trees and thresholds on the proposals of all documents."""
    drawn = F.xxhash64(F.col(doc_id), F.col(text), F.lit("pii"))  # rows without an id are told apart by their texts
    plain = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(base_spans(plain).alias("base"), proposals(plain).alias("proposed"),
                       (F.pmod(F.shiftright(drawn, 32), F.lit(CALIBRATION_EVERY)) == 0).alias("calibrates"))
    rows = durable(read.select("calibrates", "base", F.explode("proposed").alias("span"))
                   .select("calibrates", F.col("span.kind").alias("kind"), features(F.col("span")).alias("features"),
                           label(F.col("span"), F.col("base")).alias("label"))
                   .where("label is not null").unionByName(_prior(docs.sparkSession))
                   .groupBy("calibrates", "kind", "features", "label").agg(F.count(F.lit(1)).alias("n")))  # formats repeat
    trees = boosting.fit(rows.where("not calibrates").select("features", "label", "n"))
    scores = (rows.where("calibrates").select("kind", "label", "n", F.floor(trees.probability(F.col("features")) * 1000).alias("score"))
              .groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("confirmed")).collect())
    return PiiModel(trees, {kind: limit for number, kind in enumerate(KINDS) if (limit := _threshold(
        {r["score"]: (r["n"], r["confirmed"]) for r in scores if r["kind"] == number})) is not None})


def _threshold(by_score: dict[int, tuple[int, int]]) -> float | None:
    """The lowest score from which the share of confirmed proposals stays high enough; None without evidence."""
    seen = confirmed = 0
    limit = None
    for score in sorted(by_score, reverse=True):
        seen, confirmed = seen + by_score[score][0], confirmed + by_score[score][1]
        if confirmed >= LEAST_CONFIRMED and confirmed >= LEAST_PRECISION * seen:
            limit = score / 1000
    return limit


def listed(spans: Column) -> Column:
    """kind:start:end, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, model: PiiModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added, spans): base spans, spans the model adds, and all of them as one text.

    NULL texts are empty and have no spans. Spans of different kinds may overlap. Rows that repeat stay; texts are
    read whole; an empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("added", model.added(F.col("text"), F.col("base")))
    return rows.select("doc_id", "base", "added", listed(F.concat("base", "added")).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _redact_kind(text: Column, kind: str, pattern: str, replaces) -> Column:
    """Replace the matches that ``replaces(hit, left, right)`` accepts by the kind in brackets."""
    mark = F.lit(f"[{kind.upper()}]")
    hits = F.when(F.rlike(text, F.lit(GUARDS[kind])), F.regexp_extract_all(text, F.lit(pattern), 0))

    def rebuilt(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: F.array_join(F.transform(gaps, lambda gap, i: F.when(
            i < F.size(found), F.concat(gap, let(F.element_at(found, F.least(i + 1, F.size(found))), lambda h: F.when(
                replaces(h, F.right(gap, F.lit(_CONTEXT)), F.left(F.element_at(gaps, F.least(i + 2, F.size(gaps))), F.lit(_CONTEXT))),
                mark).otherwise(h)))).otherwise(gap)), ""))
    return let(hits, lambda found: F.when(F.size(found) > 0, rebuilt(found)).otherwise(text))


def redact(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets; ``n_chars``, if there, follows the text.

    A text without spans stays as it is, NULL stays NULL. Kinds are replaced one after the other, base rules first and
    last, each in the text as it then stands: overlapping spans go too, and so does what an added span stood against
    (a card number right behind a phone number). All other columns are unchanged.
    """
    def base(kind):
        accept = ACCEPT[kind]
        return lambda hit, left, right: accept(hit) if accept else F.lit(True)

    def chosen(kind):
        possible = POSSIBLE.get(kind, lambda hit: F.lit(True))
        return lambda hit, left, right: possible(hit) & model.selects(F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), hit.alias("hit"), left.alias("left"), right.alias("right")))
    changed = docs.withColumn("__text__", F.col(text))
    for rule, patterns in ((base, BASE), (chosen, PROPOSED), (base, BASE)):
        for kind in KINDS:
            if rule is base or kind in model.thresholds:
                changed = changed.withColumn("__text__", _redact_kind(F.col("__text__"), kind, patterns[kind], rule(kind)))
    values = {text: F.col("__text__")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__text__").eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(
            F.char_length("__text__").cast("long"))
    return changed.withColumns(values).drop("__text__").select(*docs.columns)
