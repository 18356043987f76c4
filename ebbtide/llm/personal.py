"""Personal data: base patterns, and identifiers found by bootstrapped lexical contexts.

The base patterns find seeds (mail and network addresses, card and phone numbers).  The words around the
seeds make lexical patterns, which also fit other identifier-like tokens.  Scores run over the graph of
patterns and values for a few rounds: a pattern is as good as the share of all places it fits in the
corpus that hold scored values, a value as good as its best pattern.  Tokens in patterns of high
confidence are added as spans of kind ``id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import SPACE, let, saved, saved_in_loop, unclash, words_of

# A match can only begin where the run it begins with begins, or where the match before it ended; saying so
# and never giving back a character keeps the search linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Rounds of scoring, least distinct scored values of a pattern, and least share of its places that hold them.
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8
#: More rows than this are joined by a shuffle instead of being sent to every task (under 200 bytes each).
BROADCAST_ROWS = 200_000
#: One in so many documents gives the first bound on the places of a pattern.
PART = 16
#: Characters beside a token that nearly always hold the words wanted.
NEAR = 120
FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "n_id", "base_spans", "spans")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may: str  # a quick test that every text with a match passes


KINDS = (
    Kind("email", EMAIL, "@[A-Za-z0-9-]+[.]"),
    Kind("ip", IP, r"[0-9]\.[0-9]+\.[0-9]"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9]){13}"),
    Kind("phone", PHONE, r"\+[0-9]"),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(digit: Column, k: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(k % 2 == 0, digit.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        size = F.length(_digits(found))
        return F.when(size.between(14, 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All matches from left to right: ``start``, ``order``, ``end`` (in characters), ``kind``, ``value``.

    The text is cut at the matches; a match begins after all pieces and matches before it.
    """
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")

    def placed(values: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["piece"])
            end = start + F.length(pair["value"])
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        pairs = F.arrays_zip(pieces.alias("piece"), values.alias("value"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind."""
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    found = [
        F.when(
            text.rlike(kind.may),
            _checked(matches(text, kind.pattern, kind.name, n), kind.name),
        ).otherwise(empty)
        for n, kind in enumerate(KINDS)
    ]
    return F.sort_array(F.concat(*found))


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda span: _valid(kind, span["value"]))


def _shape(word: Column) -> Column:
    """A context word: lower case, identifier-like tokens all alike."""
    return F.when(word.rlike("[0-9@]"), "#").otherwise(F.lower(word))


def _contexts(before: Column, after: Column) -> Column:
    """Patterns of a place: the two words before it, and the words on both sides (none at an edge of the text)."""
    near, far, next_ = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.get(after, F.lit(0))
    two = F.when(F.size(before) >= 2, F.concat(F.lit("L "), far, F.lit(" "), near, F.lit(" _")))
    both = F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("B "), near, F.lit(" _ "), next_))
    return F.array_compact(F.array(two, both))


def _before(text: Column, start: Column) -> Column:
    """Words before a place, at least the last two; only words longer than usual need more than a short stretch."""
    short = words_of(F.substr(text, F.greatest(start - NEAR + 1, F.lit(1)), F.least(start, F.lit(NEAR))))
    return let(
        short, lambda found: F.when((F.size(found) > 2) | (start <= NEAR), found).otherwise(words_of(F.substr(text, F.lit(1), start)))
    )


def _after(text: Column, end: Column) -> Column:
    """Words after a place, at least the first."""
    short = words_of(F.substr(text, end + 1, F.lit(NEAR)))
    whole = words_of(F.substr(text, end + 1))
    return let(short, lambda found: F.when((F.size(found) > 1) | (F.length(text) <= end + NEAR), found).otherwise(whole))


def occurrences(docs: DataFrame) -> DataFrame:
    """Identifier-like tokens of ``docs`` (id, body, text, base) that are seeds or lie outside all base spans."""
    tokens = docs.where(F.col("text").rlike("[0-9@]")).withColumn("tokens", matches(F.col("text"), TOKEN, "id", len(KINDS)))

    def inside(token: Column) -> Column:
        return F.filter("base", lambda span: (span["start"] < token["end"]) & (span["end"] > token["start"]))

    # An inner explode would make the planner ask for filled arrays below it, and so cut every text three times.
    one = tokens.select("id", "body", "text", "base", F.explode_outer("tokens").alias("token"))
    judged = one.where("token IS NOT NULL").withColumn("over", inside(F.col("token")))
    begins = F.get("over", F.lit(0))["start"].between(F.col("token.start"), F.col("token.end") - 1)
    kept = judged.where((F.size("over") == 0) | begins)
    seed = F.size("over") > 0
    shaped_before = F.transform(F.slice(F.reverse(_before(F.col("text"), F.col("token.start"))), 1, 2), _shape)
    shaped_after = F.transform(F.slice(_after(F.col("text"), F.col("token.end")), 1, 1), _shape)
    core = F.regexp_replace(F.col("token.value"), "^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", "")
    lead = F.length(F.regexp_extract(F.col("token.value"), "^[^A-Za-z0-9+@]*", 0))
    return kept.select(
        "id",
        "body",
        (F.col("token.start") + lead).alias("start"),
        (F.col("token.start") + lead + F.length(core)).alias("end"),
        F.when(seed, F.get("over", F.lit(0))["value"]).otherwise(core).alias("value"),
        seed.alias("seed"),
        _contexts(F.reverse(shaped_before), shaped_after).alias("patterns"),
    ).where(F.length("value") > 0)


def pattern_places(docs: DataFrame, patterns: DataFrame, small: bool) -> DataFrame:
    """How many places of all texts each of ``patterns`` fits: ``pattern``, ``places``."""
    words = F.transform(words_of(F.col("text")), _shape)

    def around(words: Column) -> Column:
        last = F.size(words) - 1
        at = F.sequence(F.lit(0), last)
        two = F.transform(
            F.filter(at, lambda k: k >= 2),
            lambda k: F.xxhash64(F.lit("L"), F.get(words, k - 2), F.get(words, k - 1)),
        )
        both = F.transform(
            F.filter(at, lambda k: (k >= 1) & (k < last)),
            lambda k: F.xxhash64(F.lit("B"), F.get(words, k - 1), F.get(words, k + 1)),
        )
        return F.concat(two, both)

    hashed = docs.select(let(words, lambda w: F.when(F.size(w) > 1, around(w))).alias("keys"))
    hashed = hashed.select(F.explode_outer("keys").alias("key"))  # outer as in occurrences; the join drops NULL
    parts = F.split("pattern", " ")
    wanted = patterns.select(
        "pattern",
        F.when(parts[0] == "L", F.xxhash64(F.lit("L"), parts[1], parts[2]))
        .otherwise(F.xxhash64(F.lit("B"), parts[1], F.get(parts, F.lit(3))))
        .alias("key"),
    )
    return hashed.join(F.broadcast(wanted) if small else wanted, "key").groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def score_graph(edges: DataFrame, places: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """Pattern scores after some rounds: ``pattern``, ``score``, ``values`` (distinct values scored by then).

    ``edges`` has one row per pattern and value (``n`` places, ``seed``).
    """
    graph = edges.join(places, "pattern")
    values = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("worth"))
    for _ in range(rounds):
        scored = (
            graph.join(values, "value")
            .groupBy("pattern")
            .agg(
                (F.sum(F.col("n") * F.col("worth")) / F.max("places")).alias("score"),
                F.count_if(F.col("worth") >= confidence).alias("values"),
            )
        )
        strong = scored.where((F.col("values") >= support) & (F.col("score") >= confidence))
        raised = graph.join(strong.select("pattern", "score"), "pattern").groupBy("value").agg(F.max("score").alias("raised"))
        values = saved_in_loop(
            values.join(raised, "value", "left").select("value", F.greatest("worth", F.coalesce("raised", F.lit(0.0))).alias("worth"))
        )
    return strong


def find_personal(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Every row with ``FIELDS``: counts by kind, ``base_spans`` and all ``spans`` (start, order, end, kind, value).

    Positions count characters, the end is exclusive.  A NULL text counts as empty and has no spans; a NULL
    id is an id; equal rows get equal results and their places count each; documents with the same id and
    different texts are told apart by a hash.  An empty frame stays empty, and input columns with an added name are replaced.
    """
    frame = unclash(frame, FIELDS)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = frame.select(F.col(key).alias("id"), F.xxhash64(whole).alias("body"), whole.alias("text"))
    found = saved(occurrences(docs.withColumn("base", base_spans(F.col("text")))))
    edges = saved(
        found.select("value", "seed", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    )
    wide = saved(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support).select("pattern"))
    # Places in some of the documents are a lower bound: a pattern that fits mostly other words there already
    # cannot become confident, and is not looked for in all documents.
    some = pattern_places(docs.where(F.pmod("body", F.lit(PART)) == 0), wide, wide.count() <= BROADCAST_ROWS)
    fitting = edges.groupBy("pattern").agg(F.sum("n").alias("fitting")).join(wide, "pattern").join(some, "pattern", "left")
    wide = saved(fitting.where(F.col("fitting") >= confidence * F.coalesce("places", F.lit(0))).select("pattern"))
    places = saved(pattern_places(docs, wide, wide.count() <= BROADCAST_ROWS))
    strong = score_graph(edges, places, rounds, support, confidence).select("pattern")
    added = (
        found.where(~F.col("seed"))
        .select("id", "body", "start", "end", "value", F.explode("patterns").alias("pattern"))
        .join(strong, "pattern", "left_semi")
        .groupBy("id", "body")
        .agg(
            F.collect_set(
                F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("id").alias("kind"), "value")
            ).alias("_added")
        )
        .withColumnsRenamed({"id": "_id", "body": "_body"})
    )
    added = saved(added)
    few = (added.agg(F.sum(F.size("_added"))).first()[0] or 0) <= BROADCAST_ROWS
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_body"))
    joined = frame.withColumn("base_spans", base_spans(whole)).join(F.broadcast(added) if few else added, same, "left")
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    spans = F.sort_array(F.concat("base_spans", F.coalesce("_added", empty)))

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == name)).cast("long")

    counts = {f"n_{name}": count(name) for name in (*[k.name for k in KINDS], "id")}
    return joined.withColumn("spans", spans).withColumns(counts).select(*frame.columns, *FIELDS)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one, named by the first) replaced by its kind in brackets."""

    def step(state: Column, span: Column) -> Column:
        overlaps = span["start"] < state["at"]
        piece = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        out = F.when(overlaps, state["out"]).otherwise(F.concat(state["out"], piece, F.lit("<"), F.upper(span["kind"]), F.lit(">")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_personal(frame: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with personal data of ``text`` replaced by its kind; columns stay as they are."""
    found = find_personal(frame, key, text, **options)
    return found.withColumn(text, masked(F.col(text), F.col("spans"))).select(*[c for c in found.columns if c not in FIELDS])
