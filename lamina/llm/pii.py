"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds per kind."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import doc_text, stage

KINDS = ("email", "ip", "card", "phone")
#: Share of the labelled candidates, drawn by hash, that the trees are fitted on; all others calibrate.
FITTED = 0.5
#: Share of true findings that held-out candidates above a kind's threshold must have.
PRECISION = 0.98
BINS = 50
LEFT, RIGHT = 24, 8
#: Matches that are placed by one fold.
FOLD = 64

#: Generator: kind, pattern, whether it is one of the base generators, and what a text must contain to be searched.
#: Possessive repeats and the looks behind change no match; they keep very long runs linear.
GENERATORS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, "[0-9]\\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", True, "[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, "\\+[0-9]"),
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){1,8}", False, "(?i)[\\[(]at[\\])]"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", False, "[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])", False, "[0-9]{4}"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", False, "[0-9]{3}"),
    ("phone", r"(?<![0-9])00[1-9][0-9\x20().-]{7,20}[0-9](?![0-9])", False, "00[1-9]"),
)

_LOCATED = "array<struct<start:int,end:int,match:string>>"
_FOUND = "array<struct<kind:string,base:boolean,start:int,end:int,match:string,before:string,after:string>>"


def located(text: Column, pattern: str) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches give the places: each match starts where all before it has ended.  A fold copies what it has
    gathered at each step, so it runs over ``FOLD`` matches at a time, each part from where the one before it ended.
    """
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )
    width = lambda step: step["gap"] + F.coalesce(F.length(step["match"]), F.lit(0))

    def add(state: Column, step: Column) -> Column:
        start, end = state["at"] + step["gap"], state["at"] + width(step)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), step["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(step["match"].isNull(), state["out"]).otherwise(F.concat(state["out"], one)).alias("out"))

    def part(steps: Column, begin: Column) -> Column:
        return F.aggregate(steps, F.struct(begin.alias("at"), F.array().cast(_LOCATED).alias("out")), add, lambda state: state["out"])

    # The text's own pieces are named once; whatever follows refers to them.
    def parts(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLD).cast("int"))
        cut = F.transform(numbers, lambda k: F.slice(steps, k * FOLD + 1, F.lit(FOLD)))
        ends = F.transform(cut, lambda piece: F.aggregate(piece, F.lit(0), lambda n, step: n + width(step)))
        begins = F.aggregate(ends, F.array(F.lit(0)), lambda found, n: F.concat(found, F.array(F.element_at(found, -1) + n)))
        return F.flatten(F.zip_with(cut, F.slice(begins, F.lit(1), F.size(cut)), part))

    return F.flatten(F.transform(F.array(steps), parts))


def _generated(text: Column, kind: str, pattern: str, base: bool, guard: str) -> Column:
    def described(m: Column) -> Column:
        left = F.least(m["start"], F.lit(LEFT))
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["match"].alias("match"),
            F.substring(text, m["start"] - left + 1, left).alias("before"),
            F.substring(text, m["end"] + 1, F.lit(RIGHT)).alias("after"),
        )

    return F.when(text.rlike(guard), F.transform(located(text, pattern), described)).otherwise(F.array().cast(_FOUND))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    digits = digits_of(match)

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The check that a match of each kind must pass."""
    digits = F.length(digits_of(match))
    octets = F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    groups = (F.size(F.split(match, ":")) == 8) & F.forall(F.split(match, ":"), lambda p: p.rlike("^[0-9A-Fa-f]{1,4}$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when((kind == "ip") & match.contains(":"), groups)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when((digits >= 12) & (digits <= 19), luhn(match)).otherwise(False))
        .otherwise((digits >= 9) & (digits <= 15))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, key, base, extra): checked base spans, and what else the generators propose.

    One pass over the texts.  Extra spans that overlap a base span are dropped: base spans stay.
    """
    text = F.col("text")
    found = F.concat(*[_generated(text, *g) for g in GENERATORS])
    first = stage(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), found.alias("found")), "pii-matches")
    checked = F.transform("found", lambda x: F.struct(x.alias("span"), valid(x["kind"], x["match"]).alias("ok")))
    second = stage(first.select("doc_id", "key", checked.alias("checked")), "pii-checked")
    base = F.transform(F.filter("checked", lambda x: x["span"]["base"] & x["ok"]), lambda x: x["span"])
    third = stage(second.select("doc_id", "key", "checked", base.alias("base")), "pii-base")
    free = F.filter(
        "checked",
        lambda x: ~x["span"]["base"] & ~F.exists("base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])),
    )
    return stage(third.select("doc_id", "key", "base", "checked", free.alias("extra")), "pii-candidates")


#: None of them settles a check: neither the check itself, nor lengths and digit counts of the kinds whose check counts them.
#: Nor any that is the same in all base matches of a kind, as it would tell the generators apart, not the findings.
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "card_digits", "card_groups", "left_word", "right_word", "spoken", "spoken_other", "quoted", "word_before")


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of each span (columns span, ok) as numbers."""
    span = F.col("span")
    kind, match, before, after = span["kind"], span["match"], F.lower(span["before"]), F.lower(span["after"])
    number = lambda c: c.cast("double")
    return spans.withColumns(
        {
            **{f"is_{k}": number(kind == k) for k in KINDS},
            "card_digits": F.when(kind == "card", number(F.length(digits_of(match)))).otherwise(0.0),
            "card_groups": F.when(kind == "card", number(F.size(F.split(match, "[^0-9]")))).otherwise(0.0),
            "left_word": number(before.rlike(r"\w$")),
            "right_word": number(after.rlike(r"^\w")),
            "spoken": number(before.rlike(r"\b(card|visa|iban|tel|phone|call|mobile|fax|mail|e-mail|contact|ip|host|server|addr)\w*\W*$")),
            "spoken_other": number(before.rlike(r"\b(part|order|serial|version|ver|build|release|model|item|sku|isbn|ref|id|no|nr|number|code|page|section)\w*\W*$")),
            "quoted": number(before.rlike(r"[\"'=:]\s*$")),
            "word_before": number(before.rlike(r"[a-z]\W*$")),
        }
    )


def fit(labelled: DataFrame) -> tuple:
    """(model, thresholds by kind) from rows (span, ok, label, draw), or (None, {}) without examples of both labels.

    ``draw`` in [0, 1) is a hash: what lies in the first part is fitted on, the second part calibrates, so every row has its use.
    Features are flags and small counts, so rows with the same ones are counted, and the trees take the counts as
    weights: what is fitted on grows with the different combinations, not with the rows.
    """
    fitting = (F.col("draw") < FITTED).alias("fitting")
    rows = stage(with_features(labelled).groupBy(fitting, "label", *FEATURES).agg(F.count("*").cast("double").alias("n")), "pii-training")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = assembled.where("fitting").select("features", "label", "n")
    if {r["label"] for r in fitted.select("label").distinct().collect()} != {0.0, 1.0}:
        return None, {}
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=7, stepSize=0.2, weightCol="n").fit(fitted)
    held = model.transform(assembled.where("NOT fitting"))
    score = vector_to_array("probability")[1]
    kind = F.coalesce(*[F.when(F.col(f"is_{k}") == 1.0, F.lit(k)) for k in KINDS])
    counted = held.groupBy(kind.alias("kind"), F.floor(score * BINS).cast("int").alias("bin")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    bins = {(r["kind"], r["bin"]): (r["good"], r["n"]) for r in counted.collect()}
    thresholds = {}
    for kind in KINDS:
        good = total = 0
        for b in range(BINS, BINS // 2 - 1, -1):
            g, n = bins.get((kind, b), (0, 0))
            good, total = good + g, total + n
            if total and good / total >= PRECISION:
                thresholds[kind] = b / BINS
    return model, thresholds


def _best_apart(ranked: Column) -> Column:
    """Of accepted spans in the order of their scores (of equals the longer, then the first) those that overlap none before them."""

    def keep(kept: Column, one: Column) -> Column:
        s = one["s"]
        return F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ranked, F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>"), keep)


def _joined(spans: Column) -> Column:
    order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def judged(each: DataFrame, labels: DataFrame) -> DataFrame:
    """The spans (columns doc_id, span, ...) that ``labels`` names, with their label; of contradicting ones the lowest."""
    place = ["doc_id", "kind", "start", "end"]
    known = labels.select(F.col("doc_id").cast("long"), "kind", F.col("start").cast("int"), F.col("end").cast("int"), F.col("label").cast("double").alias("label"))
    known = known.where("label is not null").groupBy(*place).agg(F.min("label").alias("label"))
    return each.withColumns({c: F.col(f"span.{c}") for c in place[1:]}).join(known, place).drop(*place)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found), one per row of ``docs``.

    The n columns count base spans; ``spans`` lists base and added spans as kind:start:end, by start and then in the
    order of ``KINDS``; ``base_sha256`` is the hash of that list of base spans; ``found`` has all spans with
    their texts.  Added spans are proposals of the other generators that touch no base span, pass their own check
    and whose score reaches their kind's threshold; where such spans overlap, the best score stays.  Trees are fitted on ``labels`` (doc_id, kind, start, end, label 0 or 1):
    matches of any generator that people have judged; labels of what no generator proposes are left out.  Without labels
    they are fitted on base matches: those that pass their check are true.  They see no check, so what they learn is in
    which surroundings matches pass.  Labels that are all alike teach nothing, and no span is added.
    Null text counts as empty and has no spans.  Repeated rows get equal rows; rows that share an id but not a
    text are told apart.  An empty table gives none.
    """
    rows = candidates(doc_text(docs, id_col, text_col))
    each = rows.select("doc_id", "key", F.explode("checked").alias("x")).select("doc_id", "key", "x.span", "x.ok")
    draw = F.pmod(F.xxhash64("key", "span.kind", "span.start"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    known = judged(each, labels) if labels is not None else each.where("span.base").withColumn("label", F.col("ok").cast("double"))
    model, thresholds = fit(known.withColumn("draw", draw))
    added = rows.where("false").select("key", F.lit(None).cast("array<struct<kind:string,start:int,end:int,match:string>>").alias("added"))
    if thresholds:
        extra = with_features(rows.select("key", F.explode("extra").alias("x")).select("key", "x.span", "x.ok").where("ok"))
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(extra))
        least = F.create_map(*[y for k, t in thresholds.items() for y in (F.lit(k), F.lit(t))])
        score = vector_to_array("probability")[1]
        accepted = scored.where(score >= F.coalesce(least[F.col("span.kind")], F.lit(2.0)))
        spans = accepted.select("key", (-score).alias("less"), F.struct("span.kind", "span.start", "span.end", "span.match").alias("s")).distinct()
        ranked = F.array_sort(F.collect_list(F.struct("less", (F.col("s.start") - F.col("s.end")).alias("shorter"), "s")))
        added = stage(spans.groupBy("key").agg(_best_apart(ranked).alias("added")), "pii-added")
    slim = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))
    met = rows.join(added, "key", "left").select("doc_id", slim.alias("base"), "added")
    met = met.withColumn("found", F.concat("base", F.coalesce("added", F.array().cast(met.schema["added"].dataType))))
    kinds = F.transform("base", lambda x: x["kind"])
    count = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    return met.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")
