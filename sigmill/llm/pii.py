"""Operator 8: personal data by bootstrapped contextual extraction, DataFrame functions only.

Four regular expressions with checks find the base entities (e-mail, IP, card,
phone). These seed a graph of lexical patterns and instances. An instance is an
identifier-like token (it holds a digit or @) or a seed. Its patterns are the one
and the two words before it, the one and the two words after it, and the word
before it with its own shape (each digit as 9, runs of letters as a). Spark
iterates

    confidence(pattern) = sum of its instances' scores / (identifier-like tokens that fill it + PRIOR)
    score(instance)     = 1 for seeds, else the best confidence of its sure patterns on the other side

where a sure pattern has at least `MIN_CONFIDENCE`. What a pattern says of a
token never comes back to it: the left patterns count what the right ones say,
and the other way round. A pattern of fewer than `MIN_SUPPORT` different scored
instances has confidence 0, and so has one whose words stand beside a filling
token in less than `MIN_SHARE` of all their places in the texts: a word like
"of" says nothing, whatever the few identifiers beside it are. A token that fills a sure pattern is a discovered
span of the kind that most of the pattern's scored instances have. Base spans
always stay.

Positions come from the gaps between matches: `split` and `regexp_extract_all`
by one expression give gaps and matches, whose lengths add up in a window over
the document's matches. Only matches are shuffled, not texts.

Defined cases: null and empty texts have no spans; spans of different kinds may
overlap; repeated rows get a row each; rows with a null doc_id are kept; context
words count whole, and two of them are a pattern where one blank parts them; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
ROUNDS = 3
#: Added to a pattern's places, so that few of them prove little.
PRIOR = 1.0
#: Least share of the places of a pattern's words where a token fills the pattern.
MIN_SHARE = 0.1
#: Phrases up to which they are broadcast to the count over all texts.
MAX_BROADCAST_PHRASES = 100_000
#: Parts into which the rows of each pattern and instance are dealt for a join.
SALTS = 8

#: Possessive forms of the fixed patterns: the same matches without backtracking over long runs.
#: A run of name characters can only start a match at its first character or where the last match ended.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
#: Unicode noncharacters that stand for the characters of a masked span of each kind, and for themselves in a text.
_FILL = "﷐﷑﷒﷓"
_OTHER = "﷔"
_SPACE = r"\x20\x09-\x0D"
_BLANKS = "\t\n\x0b\x0c\r"
_SLOT = "|".join(f"{c}+" for c in _FILL) + (
    f"|(?<![^{_SPACE}{_FILL}])[^{_SPACE}{_FILL}0-9@]*+[0-9@][^{_SPACE}{_FILL}]*+"
)
SLOT = len(KINDS)
_LEADING = r"""^["'(<\[{]*+"""
_TRAILING = r"""[.,;:!?)>\]}"']++$"""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        x = F.substr(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _let(digits, _luhn)).otherwise(False)


def _cut(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """body(gap, match) for each match and the gap before it; the last gap comes with a null match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), body)


def _masked(text: Column) -> Column:
    """The text with every character of a valid base span replaced by its kind's filler."""
    def masker(kind: str, fill: str) -> Callable[[Column], Column]:
        def one(gap: Column, match: Column) -> Column:
            kept = F.when(_valid(kind, match), F.repeat(F.lit(fill), F.length(match))).otherwise(match)
            return F.concat(gap, F.coalesce(kept, F.lit("")))

        return lambda t: F.when(t.rlike(_NEEDS[kind]), F.array_join(_cut(t, _PATTERNS[kind], one), "")).otherwise(t)

    out = F.translate(text, _FILL, _OTHER * len(_FILL))
    for kind, fill in zip(KINDS, _FILL, strict=True):
        out = _let(out, masker(kind, fill))
    return out


def _entries(text: Column) -> Column:
    """All matches of a text, in order within each kind, the slots of the masked text last."""
    def entry(number: int, gap: Column, match: Column, ok: Column, left: Column, head: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(match).alias("size"),
            ok.alias("ok"),
            match.alias("match"),
            left.alias("left"),
            head.alias("head"),
        )

    none = F.lit(None).cast("string")

    def base(number: int, kind: str) -> Column:
        found = _cut(text, _PATTERNS[kind], lambda gap, match: entry(number, gap, match, _valid(kind, match), none, none))
        found = F.filter(found, lambda e: e["match"].isNotNull())
        return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast(_TYPE))


    def slot(gap: Column, match: Column) -> Column:
        left = F.lower(F.trim(F.substring_index(F.rtrim(gap), " ", -2)))
        head = F.lower(F.trim(F.substring_index(F.ltrim(gap), " ", 2)))
        return entry(SLOT, gap, match, F.lit(True), left, head)

    # All blanks become spaces, one for one, so that a gap's last and first words are cut off at spaces.
    slots = _let(F.translate(_masked(text), _BLANKS, " " * len(_BLANKS)), lambda masked: _cut(masked, _SLOT, slot))
    return F.flatten(F.array(*[base(n, k) for n, k in enumerate(KINDS)], slots))


_TYPE = "array<struct<kind:int,gap:int,size:int,ok:boolean,match:string,left:string,head:string>>"


def _key() -> Column:
    """A digest of id and text, 128 bits wide: rows that share it are equal in both."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))


def matches(docs: DataFrame) -> DataFrame:
    """One row for each match of each document, and one with null kind for a document without digit and @.

    (rid, doc_id, key, pos, kind, start, end, ok, match, left, right); rid numbers the rows, key repeats with equal rows.
    """
    entries = F.when(F.col("text").rlike("[0-9@]"), _let(F.col("text"), _entries))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", _key().alias("key"), entries.alias("entries"))
    rows = rows.select("rid", "doc_id", "key", F.posexplode_outer("entries").alias("pos", "entry")).select("rid", "doc_id", "key", "pos", "entry.*")
    # checkpointed before rows are shuffled: rid is assigned once.
    rows = checkpoint(rows)
    order = W.partitionBy("rid", "kind").orderBy("pos")
    start = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order) - F.coalesce("size", F.lit(0))
    return rows.withColumn("start", start).select(
        "rid", "doc_id", "key", "pos", "kind", "start", (F.col("start") + F.col("size")).alias("end"), "ok", "match", "left",
        F.lead("head").over(order).alias("right"),
    )


def _slots(found: DataFrame) -> DataFrame:
    """(rid, doc_id, key, place, start, end, lead, trail, seed, instance, left, right): the slots, with up to two words on each side."""
    first = F.substring("match", 1, 1)
    seed = F.coalesce(*[F.when(first == c, F.lit(i)) for i, c in enumerate(_FILL)])
    slots = found.filter((F.col("kind") == SLOT) & F.col("match").isNotNull()).withColumn("seed", seed)
    place = F.row_number().over(W.partitionBy("rid").orderBy("pos")) - 1
    lead = F.length(F.regexp_extract("match", _LEADING, 0))
    trail = F.length(F.regexp_extract("match", _TRAILING, 0))
    slots = slots.withColumn("place", place).withColumn("lead", lead).withColumn("trail", trail)
    plain = slots.filter(F.col("seed").isNull() & (F.col("lead") + F.col("trail") < F.length("match"))).select(
        "rid", "doc_id", "key", "place", (F.col("start") + F.col("lead")).alias("start"), (F.col("end") - F.col("trail")).alias("end"),
        "lead", "trail", F.lit(None).cast("int").alias("seed"),
        F.lower(F.expr("substring(match, lead + 1, length(match) - lead - trail)")).alias("instance"), "left", "right",
    )
    base = found.filter((F.col("kind") < SLOT) & F.col("ok")).select("rid", F.col("kind").alias("seed"), "start", F.lower("match").alias("instance"))
    seeds = slots.filter(F.col("seed").isNotNull()).select(
        "rid", "doc_id", "key", "place", "start", "end", F.lit(0).alias("lead"), F.lit(0).alias("trail"), "seed", "left", "right"
    )
    seeds = seeds.join(base, ["rid", "seed", "start"]).select(*plain.columns)
    return plain.unionByName(seeds)


def _patterned(slots: DataFrame) -> DataFrame:
    """The slots with each of their patterns: (..., pattern, side); side 0 is the left one, 1 the right one."""
    shape = F.regexp_replace(F.regexp_replace("instance", "[0-9]", "9"), r"\p{L}+", "a")
    before, after = F.substring_index("left", " ", -1), F.substring_index("right", " ", 1)
    patterns = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("L"), before)),
        F.when(F.col("left").contains(" "), F.concat(F.lit("M"), "left")),
        F.when(F.col("left") != "", F.concat(F.lit("S"), before, F.lit(" "), shape)),
        F.when(F.col("right") != "", F.concat(F.lit("R"), after)),
        F.when(F.col("right").contains(" "), F.concat(F.lit("T"), "right")),
    )
    rows = slots.withColumn("pattern", F.explode(F.array_compact(patterns))).drop("left", "right")
    return rows.withColumn("side", F.when(F.substring("pattern", 1, 1).isin("R", "T"), 1).otherwise(0))


def _joined(rows: DataFrame, table: DataFrame, on: list[str], spread: str) -> DataFrame:
    """rows joined with a smaller table; each key's rows are dealt by `spread`, so that no frequent key is one task."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def _frequencies(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, freq): how often each word, or two words parted by one blank, stand in all texts.

    Few phrases are broadcast to those of the texts; many meet the counts of all, which are summed up before.
    """
    def found(text: Column) -> Column:
        def pairs(words: Column) -> Column:
            after = F.slice(words, 2, F.size(words))
            return F.zip_with(words, after, lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)))

        return _let(F.split(F.lower(F.translate(text, _BLANKS, " " * len(_BLANKS))), " "), lambda words: F.concat(words, pairs(words)))

    everywhere = docs.select(F.explode(found(F.col("text"))).alias("phrase"))
    if phrases.count() <= MAX_BROADCAST_PHRASES:
        return everywhere.join(F.broadcast(phrases), "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("freq"))
    return everywhere.groupBy("phrase").agg(F.count("*").alias("freq")).join(phrases, "phrase", "left_semi")


def _graph(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """(pattern, instance, side, times, seed, places) of the patterns with enough different instances and a large enough share."""
    # One edge for each pattern and instance, with the times that they meet; summed up before a frequent pattern's rows meet.
    edges = checkpoint(_patterned(slots).groupBy("pattern", "instance", "side").agg(F.count("*").alias("times"), F.max("seed").alias("seed")))
    counts = edges.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("times").alias("places")).filter(F.col("support") >= MIN_SUPPORT)
    words = F.expr("substring(pattern, 2)")
    words = F.when(F.startswith("pattern", F.lit("S")), F.substring_index(words, " ", 1)).otherwise(words)
    counts = checkpoint(counts.select("pattern", "places", words.alias("phrase")))
    freq = _frequencies(docs, checkpoint(counts.select("phrase").distinct()))
    kept = counts.join(freq, "phrase").filter(F.col("places") >= F.lit(MIN_SHARE) * F.col("freq")).select("pattern", "places")
    return checkpoint(_joined(edges, kept, ["pattern"], "instance"))


def patterns(docs: DataFrame, slots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, kind) of the sure patterns of the graph of the slots of docs."""
    graph = _graph(docs, slots)
    known = graph.filter(F.col("seed").isNotNull()).groupBy("instance").agg(F.max("seed").alias("kind"))
    seeds = checkpoint(known.select("instance", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.lit(1.0).alias("score"), "kind", F.lit(1).alias("rank")))
    scores = seeds.drop("rank")
    for left in reversed(range(rounds)):
        weighed = _joined(graph, scores, ["instance", "side"], "pattern")
        by_kind = weighed.groupBy("pattern", "side", "places", "kind").agg(
            F.sum(F.col("score") * F.col("times")).alias("value"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("support")
        )
        sure = by_kind.groupBy("pattern", "side", "places").agg(
            F.sum("value").alias("value"), F.sum("support").alias("support"), F.max_by("kind", F.struct(F.round("value", 6), -F.col("kind"))).alias("kind")
        )
        sure = sure.withColumn("confidence", F.round(F.col("value") / (F.col("places") + F.lit(PRIOR)), 9))
        sure = checkpoint(sure.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)).select("pattern", "side", "confidence", "kind"))
        if left:
            told = _joined(graph, sure.drop("side"), ["pattern"], "instance").select(
                "instance", (1 - F.col("side")).alias("side"), F.col("confidence").alias("score"), "kind", F.lit(0).alias("rank"), "pattern"
            )
            best = F.max(F.struct("rank", "score", "pattern", "kind")).alias("best")
            scores = told.unionByName(seeds.withColumn("pattern", F.lit(""))).groupBy("instance", "side").agg(best).select("instance", "side", "best.score", "best.kind")
    return sure.drop("side")


def discover(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rid, doc_id, key, place, start, end, lead, trail, kind) of the tokens that sure patterns reveal."""
    slots = checkpoint(_slots(found))
    sure = patterns(docs, slots, rounds)
    revealed = _joined(_patterned(slots.filter(F.col("seed").isNull())), sure, ["pattern"], "rid")
    best = F.max_by("kind", F.struct("confidence", "pattern")).alias("kind")
    return revealed.groupBy("rid", "doc_id", "key", "place", "start", "end", "lead", "trail").agg(best)


def _listed(entries: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(entries, lambda e: F.concat_ws(":", F.element_at(names, e["kind"] + 1), e["start"].cast("string"), e["end"].cast("string"))), ","
    )


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, all): arrays of (kind, start, end), sorted; kind is a place in KINDS, positions are code points."""
    found = matches(docs)
    base = (F.col("kind") < SLOT) & F.col("ok")
    entry = F.struct("kind", "start", "end")
    rows = found.select("rid", "doc_id", F.when(base, entry).alias("base"), F.when(base, entry).alias("any"))
    more = discover(docs, found)
    empty = F.lit(None).cast(rows.schema["base"].dataType)
    extra = more.select("rid", "doc_id", empty.alias("base"), F.struct("kind", "start", "end").cast(rows.schema["base"].dataType).alias("any"))
    # A document's spans meet in one row, as the result asks.
    return rows.unionByName(extra).groupBy("rid", "doc_id").agg(
        F.array_sort(F.collect_list("base")).alias("base"), F.array_sort(F.collect_list("any")).alias("all")
    ).drop("rid")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for each row of docs."""

    def counted(number: int) -> Column:
        return F.size(F.filter("base", lambda e: e["kind"] == number)).cast("long")

    counts = [counted(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return spans(docs).select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_found"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with base and discovered spans in `text` replaced by [KIND]; n_chars is recounted where present.

    The columns of docs travel in one struct, so their names don't matter.
    """
    found = matches(docs)
    more = discover(docs, found)
    marks = more.select("key", F.struct("place", "lead", "trail", "kind").alias("mark")).distinct()
    marks = checkpoint(marks.groupBy("key").agg(F.collect_list("mark").alias("marks")))
    none = F.array().cast(marks.schema["marks"].dataType)
    held = docs.select(F.struct("*").alias("row"), "text", _key().alias("key"))
    marked = held.withColumn("marks", none) if marks.isEmpty() else held.join(marks, "key", "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(part: Column, place: Column) -> Column:
        match = part["match"]
        mark = F.get(F.filter("marks", lambda m: m["place"] == place), F.lit(0))
        found = F.concat(
            F.substr(match, F.lit(1), mark["lead"]),
            F.element_at(names, mark["kind"] + 1),
            F.substr(match, F.length(match) - mark["trail"] + 1),
        )
        base = F.coalesce(*[F.when(match.startswith(c), F.lit(f"[{k.upper()}]")) for c, k in zip(_FILL, KINDS, strict=True)])
        return F.concat(part["gap"], F.coalesce(base, found, match, F.lit("")))

    parts = _let(
        _masked(F.col("text")), lambda masked: _cut(masked, _SLOT, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    )
    text = F.array_join(F.transform(parts, rebuilt), "")
    text = F.when(F.col("text").rlike("[0-9@]"), text).otherwise(F.col("text"))
    out = marked.withColumn("marks", F.coalesce("marks", none)).select("row", text.alias("text"))
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
