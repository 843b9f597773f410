"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Base spans are the matches of three patterns.  Other long tokens of mixed characters are candidates.  The hash
of every candidate's value is counted over distinct owners and repositories of the whole corpus: a
value that several owners share is a widely copied example; one that a single owner has, in however many of its repositories, looks live.  Candidates
that look live become further spans (kind ``live``); base spans stay, each marked as live or example.  Without a column of
repositories each distinct text counts as one, so that copies of a document are no repositories of their own.

Spans are start:end in code points, end exclusive.  Null text is the empty text, without spans.
Repeated rows give repeated results.  An owner that is null is an owner of its own.  An empty table gives no rows.  Very
long texts with very many matches take time in proportion to both: places are running sums, overlaps running maxima,
taken level by level in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import cut_lineage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# maximal runs: asking for 24 at once finds the same spans as dropping shorter ones afterwards
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS = 1  # more owners than this make a value an example

SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


BLOCK, LEVELS = 32, 4  # of running totals: linear up to BLOCK ** LEVELS matches


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column], start: Column, levels: int = LEVELS) -> Column:
    """For each place of an array, ``join`` of the values before it.  Within blocks by going through them, between blocks by the same one level up."""

    def up_to(some: Column, i: Column) -> Column:
        return F.aggregate(F.slice(some, F.lit(1), i), start, join)

    if levels == 1:
        return F.transform(values, lambda _, i: up_to(values, i))

    def block(b: Column) -> Column:
        return F.slice(values, b * BLOCK + 1, F.lit(BLOCK))

    numbers = F.sequence(F.lit(0), (F.ceil(F.size(values) / BLOCK) - 1).cast("int"))
    totals = F.transform(numbers, lambda b: F.aggregate(block(b), start, join))
    before = _let(totals, lambda t: running(t, join, start, levels - 1))
    joined = F.transform(before, lambda own, b: _let(block(b), lambda x: F.transform(x, lambda _, i: join(own, up_to(x, i)))))
    # most texts have one block of matches at most
    return F.when(F.size(values) <= BLOCK, F.transform(values, lambda _, i: up_to(values, i))).otherwise(F.flatten(joined))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Array of the pattern's matches, leftmost and non-overlapping; null where there is none.

    The pieces between the matches, and the matches, give each match's place by a running sum of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        found, between = both["found"], both["between"]
        # from the start of the match before (or of the text) to the end of the piece before the match, and the match
        steps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        ahead = _let(steps, lambda own: running(own, lambda a, n: a + n, F.lit(0)))

        def span(start: Column, m: Column) -> Column:
            return F.struct(start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), F.lit(kind).alias("kind"), m.alias("value"))

        return _let(ahead, lambda own: F.transform(found, lambda m, i: span(F.get(own, i) + F.length(F.get(between, i)), m)))

    found = _let(F.struct(matches.alias("found"), pieces.alias("between")), placed)
    # most texts have no match; those pay for one search only
    return F.when(text.rlike(pattern), found).otherwise(F.lit(None))


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more``, which do not overlap each other, that overlap none of ``base``.

    Of the base spans that start before a candidate's end, one overlaps it if the largest end lies behind
    its start: a running maximum over both in one order.
    """
    marks = F.concat(
        F.transform(more, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), F.lit(0).alias("end"), c.alias("span"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("end"), b.alias("span"))),
    )

    def clear(own: Column) -> Column:
        highest = _let(F.transform(own, lambda m: m["end"]), lambda ends: running(ends, lambda a, n: F.greatest(a, n), F.lit(0)))
        free = _let(highest, lambda high: F.transform(own, lambda m, i: F.when((m["is_base"] == 0) & (F.get(high, i) <= m["span"]["start"]), m["span"])))
        return F.array_sort(F.filter(free, lambda x: x.isNotNull()))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(_let(F.array_sort(marks), clear))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, end, kind, value): kind 0 assign (value: its second group), 1 access, 2 hex."""
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    assign = F.transform(assign, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.regexp_extract(s["value"], ASSIGN, 2).alias("value")))
    access = F.filter(spans_of(text, ACCESS, 1), lambda s: F.length(s["value"]) >= 20)
    empty = F.array().cast(SPAN)
    return F.array_sort(F.concat(*[F.coalesce(x.cast(SPAN), empty) for x in (assign, access, spans_of(text, HEX, 2))]))


def candidate_spans(text: Column) -> Column:
    """Long tokens with letters of both cases and digits, kind 3."""
    own = F.filter(spans_of(text, TOKEN, 3), lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    return F.coalesce(own.cast(SPAN), F.array().cast(SPAN))


def scan(docs: DataFrame, repository: str | None = None, owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, text_key, base, added, live, repositories): for each distinct (doc_id, text), its base spans, the added
    ones, the spans of either that look live, and the most repositories that one of those values is in.  ``text_key`` is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), (F.xxhash64(text).cast("string") if repository is None else F.coalesce(F.col(repository).cast("string"), F.lit(""))).alias("_repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), base_spans(text).alias("base"), candidate_spans(text).alias("more"))
    rows = rows.withColumn("more", apart(F.col("more"), F.col("base")))
    rows = cut_lineage(rows)  # spans without texts: small, and searched for once
    single = rows.select("doc_id", "text_key", "_repo", "_owner", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "text_key", "_repo", "_owner", "s", F.sha2(F.col("s.value"), 256).alias("hash"))
    # distinct owners and repositories of a value, each counted on rows that are made distinct before they are dealt
    owners = single.select("hash", "_owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = single.select("hash", "_repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    counts = owners.where(F.col("owners") <= max_owners).join(repos, "hash")
    by_doc = single.join(counts, "hash").groupBy("doc_id", "text_key").agg(F.collect_set(F.col("s")).alias("live"), F.max("repositories").alias("repositories"))
    plain = rows.select("doc_id", "text_key", "base", "more")
    joined = plain.join(by_doc.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left").drop("_d", "_t")
    live = F.array_sort(F.coalesce(F.col("live"), F.array().cast(SPAN)))
    return joined.select("doc_id", "text_key", "base", F.filter(live, lambda s: s["kind"] == 3).alias("added"), live.alias("live"), F.coalesce("repositories", F.lit(0)).alias("repositories"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **settings) -> DataFrame:
    """What op8 returns: counts, digest and spans of each document, how many spans look live, and the most repositories of one of those."""
    found = scan(docs, **settings)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("repositories").cast("long").alias("n_repositories"))


def redact(docs: DataFrame, mark: str = "[secret]", **settings) -> DataFrame:
    """``docs`` with each span that looks live replaced by ``mark``; examples that several owners share stay.  Null text stays null."""
    found = scan(docs, **settings).where(F.size("live") > 0).select(F.col("doc_id").alias("__secret_id"), F.col("text_key").alias("__secret_text"), F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("__secret_spans")).dropDuplicates(["__secret_id", "__secret_text"])
    keyed = docs.withColumn("__secret_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__secret_id")) & (F.col("__secret_key") == F.col("__secret_text")), "left")
    text = F.col("text")

    def cleaned(spans: Column) -> Column:
        # spans may overlap: behind is how far the spans before reach
        behind = _let(F.transform(spans, lambda s: s["end"]), lambda ends: running(ends, lambda a, n: F.greatest(a, n), F.lit(0)))

        def piece(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))

        parts = _let(behind, lambda at: F.transform(spans, lambda s, i: piece(s, F.get(at, i))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))

    clean = _let(F.array_sort("__secret_spans"), cleaned)
    return joined.withColumn("text", F.when(F.col("__secret_spans").isNull(), text).otherwise(clean)).select(*docs.columns)
