"""Personal data: base patterns, and bootstrapped contextual extraction, with DataFrame functions only.

The base spans are seeds. The two words before a seed, or what there is of them at a text's beginning, are a lexical
pattern; a pattern that precedes enough different instances of a kind, seeds or strings discovered before, is a node of a
graph whose other nodes are strings that look like identifiers and stand behind such patterns. Each round scores this
graph: a pattern's confidence is the mean score of its instances (seeds of its kind count 1), an instance's score the
noisy-or of its patterns' confidences. Instances of high score are discovered; in the next round they count as instances
wherever they stand, and so induce patterns of their own. In the end all occurrences of discovered instances behind
patterns of high confidence become spans of that kind.

Positions come from the gaps between matches: ``split`` gives the gaps of the same pattern whose matches
``regexp_extract_all`` gives. Quantifiers are possessive where nothing could be given back, so that long texts neither
recurse nor backtrack.

Defined cases: a null or empty text has no spans; repeated rows each get theirs; equal strings are one instance; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, ship, stored, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Discovered spans, of two numbers and a kind, that are sent to all workers (some 30 MB); more are joined by a shuffle.
BROADCAST_SPANS = 1 << 19
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Fixed patterns of the base spans. A match starts where a run of its first class starts, or where the last one ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Strings that may be identifiers: runs with a digit or an at sign, of six signs or more between their outer marks, and
#: groups of seven digits or more.
_SIGN = "[A-Za-z0-9._/#@+-]"
RUN, LEAST = rf"(?<!{_SIGN})(?=[A-Za-z._/#+-]*+[0-9@]){_SIGN}{{6,}}+", 6
GROUPS, LEAST_DIGITS = r"(?<![A-Za-z0-9])[(]?[0-9](?:[ ().-]{0,2}+[0-9])++", 7
#: What stands before a span: its last two words, within so many signs.
CONTEXT, BEFORE = r"((?:\S+\s+)?\S+)\s*$", 160


def _found(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of all matches, positions in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("value")))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(steps, zero, add)["out"]).otherwise(F.array().cast(kind))


def _bare(s: Column) -> Column:
    """A run without the marks around it."""
    lead = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], "^[^A-Za-z0-9]+", ""))
    bare = F.regexp_replace(s["value"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    start = (s["start"] + lead).cast("long")
    return F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("value"))


def _is_group(s: Column) -> Column:
    """Whether spaces or brackets part the digits; others are runs."""
    return s["value"].rlike("[ ()]") & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= LEAST_DIGITS)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _with_context(spans: Column, text: Column) -> Column:
    def one(s: Column) -> Column:
        width = F.least(s["start"], F.lit(BEFORE).cast("long")).cast("int")
        # a text's beginning counts as a word
        before = F.concat(F.when(s["start"] == width, F.lit("^ ")).otherwise(F.lit("")), F.substring(text, (s["start"] - width).cast("int") + 1, width))
        left = F.regexp_replace(F.lower(F.regexp_extract(before, CONTEXT, 1)), "[0-9]+", "#")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.regexp_replace(left, r"\s+", " ").alias("left"))

    return F.transform(spans, one)


def scanned(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """A row for each text: base spans by kind and candidates away from them, all with what stands before; on request
    also ``kept``, all columns of ``docs``."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")] if keep else []),
    )
    text = F.col("text")
    needs = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def valid(kind: str) -> Column:
        return F.filter(_found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))

    rows = rows.withColumns({k: F.when(needs[k], valid(k)).otherwise(none) for k in KINDS})
    rows = rows.withColumns({"runs": F.filter(F.transform(_found(text, RUN), _bare), lambda s: F.length(s["value"]) >= LEAST), "groups": F.filter(_found(text, GROUPS), _is_group)})

    def apart_from(spans: Column) -> Callable[[Column], Column]:
        return lambda s: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    rows = rows.withColumn("other", F.concat("groups", F.filter("runs", apart_from(F.col("groups")))))
    apart = F.filter("other", apart_from(F.concat(*KINDS)))
    rows = rows.withColumn("other", apart)
    return rows.select("row", "doc_id", *(["kept"] if keep else []), *[_with_context(F.col(k), text).alias(k) for k in (*KINDS, "other")])


def bootstrapped(occurrences: DataFrame, seeds: int, rounds: int, confidence: float) -> DataFrame:
    """Discovered instances: (``left``, ``value``, ``kind``) from ``occurrences`` (``kind``, null for candidates, ``left``, ``value``)."""
    # a node for each different string behind a pattern; strings repeat, so they are first made one within each task
    nodes = stored(occurrences.distinct(), "pii-nodes")
    candidates = nodes.where("kind is null").select("left", "value")
    support = nodes.where("kind is not null").groupBy("left", "kind").agg(F.count("*").alias("n_seeds"))
    found = edges = patterns = None
    for _ in range(rounds):
        counted = support.withColumn("n_found", F.lit(0).cast("long"))
        if found is not None:
            # what was discovered counts wherever it stands
            led = salted_join(candidates, found, ["value"], F.col("left")).groupBy("left", "kind").agg(F.count("*").alias("n"))
            counted = support.join(led, ["left", "kind"], "full")
            counted = counted.select("left", "kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("n_seeds", "n_seeds"), ("n", "n_found"))])
        known = stored(counted.where(F.col("n_seeds") + F.col("n_found") >= seeds), "pii-patterns")
        edges = stored(salted_join(candidates, known.select("left").distinct(), ["left"], F.col("value")), "pii-edges")
        others = edges.groupBy("left").agg(F.count("*").alias("n_others"))
        before = (F.col("n_seeds") + F.col("n_found")) / (F.col("n_seeds") + F.col("n_others") + 1)
        patterns = known.join(others, "left").withColumn("confidence", before)
        by_pattern = patterns.groupBy("left").agg(F.collect_list(F.struct("kind", "confidence")).alias("kinds"))
        by_kind = salted_join(edges, by_pattern, ["left"], F.col("value")).select("left", "value", F.inline("kinds"))
        # 1 - product of (1 - confidence), by logarithms
        scores = by_kind.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence") * 0.999999)))).alias("score"))
        scores = stored(scores, "pii-scores")
        mean = salted_join(by_kind, scores, ["value", "kind"], F.col("left")).groupBy("left", "kind").agg(F.sum("score").alias("sum_scores"))
        after = (F.col("n_seeds") + F.col("sum_scores")) / (F.col("n_seeds") + F.col("n_others") + 1)
        patterns = stored(known.join(others, "left").join(mean, ["left", "kind"]).withColumn("confidence", after), "pii-confidence")
        # a string is of one kind, the one of its highest score
        best = scores.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).where(F.col("best.score") >= confidence)
        found = stored(best.select("value", F.col("best.kind").alias("kind")), "pii-found")
    trusted = patterns.where(F.col("confidence") >= confidence).select("left", "kind")
    return salted_join(salted_join(edges, trusted, ["left"], F.col("value")), found, ["value", "kind"], F.col("left"))


def find(
    docs: DataFrame, seeds: int = 3, rounds: int = 3, confidence: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and for each kind ``<kind>`` (base) and ``<kind>_all`` (base and discovered): spans by start.

    Texts are read once; what is kept of them, spans and two words before each, is written and reread for the graph.
    """
    ship(docs.sparkSession)
    return _with_discovered(stored(scanned(docs, id_col, text_col), "pii-spans"), seeds, rounds, confidence)


def masked(
    docs: DataFrame, seeds: int = 3, rounds: int = 3, confidence: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, with every span in the text replaced by its kind in brackets. A null text stays
    null; where spans overlap, the one that starts first names the mark."""
    ship(docs.sparkSession)
    rows = _with_discovered(stored(scanned(docs, id_col, text_col, keep=True), "pii-texts"), seeds, rounds, confidence)

    def marked(kind: str) -> Column:
        return F.transform(f"{kind}_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    def add(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["mark"].alias("mark"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out")
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,start:bigint,mark:string>>").alias("out"))
    text = F.col(f"kept.`{text_col}`")
    cuts = F.aggregate(F.array_sort(F.concat(*[marked(k) for k in KINDS])), zero, add)

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    pieces = F.transform("cuts.out", lambda p: F.concat(cut(p["from"], p["start"]), p["mark"]))
    tail = cut(F.col("cuts.at"), F.length(text).cast("long"))
    new = F.when(F.size("cuts.out") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    rows = rows.withColumn("cuts", cuts)
    return rows.select(*[(new if c == text_col else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def _with_discovered(rows: DataFrame, seeds: int, rounds: int, confidence: float) -> DataFrame:
    """``rows`` of ``scanned`` with plain spans of each kind, base and all."""

    def of_kind(spans: str, kind: str | None) -> Column:
        head = F.lit(kind).cast("string").alias("kind")
        return F.transform(spans, lambda s: F.struct(head, *[s[c].alias(c) for c in ("start", "end", "value", "left")]))

    occurrences = rows.select("row", F.inline(F.concat(*[of_kind(k, k) for k in KINDS], of_kind("other", None)))).where("left <> ''")
    new = bootstrapped(occurrences.select("kind", "left", "value"), seeds, rounds, confidence)
    behind = occurrences.where("kind is null").select("row", "start", "end", "left", "value")
    # a discovered string occurs as often as it likes: its occurrences are dealt over several tasks
    hits = salted_join(behind, new, ["left", "value"], F.col("row"))
    found = stored(hits.groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("new")), "pii-new")
    span = "array<struct<start:bigint,end:bigint>>"
    # few rows have discovered spans: up to a bound they go to all workers, and texts stay where they are
    n_spans = found.agg(F.sum(F.size("new"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if n_spans <= BROADCAST_SPANS else found, "row", "left")

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def every(kind: str) -> Column:
        new = plain(F.filter("new", lambda s: s["kind"] == kind))
        return F.array_sort(F.concat(plain(F.col(kind)), F.coalesce(new, F.array().cast(span)))).alias(f"{kind}_all")

    kept = ["kept"] if "kept" in rows.columns else []
    return joined.select("doc_id", *kept, *[plain(F.col(k)).alias(k) for k in KINDS], *[every(k) for k in KINDS])
