"""Secret scans with a trigram inverted index, in DataFrame functions only.

1. From each rule's regex a Boolean trigram query is derived: which trigrams every match
   must hold (`trigram_clauses`).
2. One scan posts (trigram, document) for the trigrams that some query asks for; the
   postings are staged on shared storage.
3. Each rule's postings are intersected and united per document into candidates.
4. The texts of candidates alone are fetched (by a bitmap, then a join) and verified with the regex.
   A rule without mandatory trigrams (hex) scans every text where it is. The spans meet at the end.

A document is told by its id and its text's digest: rows that share both have the same spans.

Positions are code points, end exclusive: Spark has no function for match positions, so
they are prefix sums of the lengths of the pieces between matches and of the matches.

Defined results: null text is empty; rows are scanned one by one, so repeated rows, ties
and null ids give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import likely, staged, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the regex, and the least length of the group that must be long enough."""

    kind: str
    regex: str
    group: int
    least: int


#: The base rules, in the order in which spans with one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Spans that the index adds to the base: formats that name themselves.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
MOST_STRINGS = 64


def _exact(item) -> set[str] | None:
    """The finite set of strings that a parsed element matches, or None if it is large or infinite."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
        return {chr(v).lower() for _, v in arg}
    if op is sre.SUBPATTERN:
        return _product(arg[3])
    if op is sre.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and (inner := _product(arg[2])) is not None:
        return inner | {""}
    return None


def _product(items) -> set[str] | None:
    found = {""}
    for x in items:
        if (more := _exact(x)) is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_clauses(regex: str) -> list[list[frozenset[str]]]:
    """The derived query: for each clause, one of its sets of lower-case trigrams lies in every matching text.

    A clause comes from a stretch of the pattern with finitely many strings of three characters or
    more: an alternative per string. No clause: the regex has no mandatory trigram.
    """
    stretches, run = [], {""}
    for item in [*sre_parse.parse(regex), (None, None)]:
        more = _exact(item) if item[0] is not None else None
        if more is None or len(run) * len(more) > MOST_STRINGS:
            stretches.append(run)
            run = {""}
        if more is not None:
            run = {a + b for a in run for b in more}
    clauses = []
    for stretch in sorted((s for s in stretches if min(map(len, s)) >= 3), key=lambda s: -min(map(len, s))):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in stretch}
        clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The clause of the longest mandatory strings; empty if the regex has no mandatory trigram."""
    return next(iter(trigram_clauses(regex)), [])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _text): the key is the text's digest."""
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).select("_id", F.unhex(F.md5("_text")).alias("_key"), "_text")


def _postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(tri, _id, _key): which of the asked trigrams each document holds, letter case aside."""
    low = texts.select("_id", "_key", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("_id", "_key", F.explode(held).alias("tri"))


def _answers(rule: Rule) -> Column:
    """Whether a document's set of trigrams ``tris`` satisfies the rule's query."""
    every = F.lit(True)
    for clause in trigram_clauses(rule.regex):
        some = F.lit(False)
        for needed in clause:
            some = some | (F.size(F.array_except(F.array(*map(F.lit, sorted(needed))), "tris")) == 0)
        every = every & some
    return every


def candidates(texts: DataFrame, indexed: list[Rule]) -> DataFrame:
    """(_id, _key) and a boolean per rule, for the documents of `_texts` that some rule may match."""
    trigrams = sorted({t for r in indexed for c in trigram_clauses(r.regex) for s in c for t in s})
    index = staged(_postings(texts, trigrams))
    by_doc = index.groupBy("_id", "_key").agg(F.collect_set("tri").alias("tris"))  # at most len(trigrams) values
    flags = by_doc.select("_id", "_key", *(_answers(r).alias(f"may_{r.kind}") for r in indexed))
    return flags.where(" or ".join(f"may_{r.kind}" for r in indexed))


#: Matches that are added up one after the other; sums of such blocks are added up before.
BLOCK = 256
SPANS = "array<struct<s:int,k:int,e:int,n:int,kind:string>>"


def _named(value: Column, use) -> Column:
    """``use(value)``, with the value made once: a lambda's argument is never inlined, as a column's expression may be."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_spans(df: DataFrame, rule: Rule, order: int, may: Column) -> DataFrame:
    """Adds ``_sp_<kind>``: each match's end is the sum of the matches and of the pieces between them so far.

    Sums run in two levels, over blocks and within a block, so the work grows with the matches (times BLOCK at most).
    """
    pattern, k = F.lit(rule.regex), rule.kind
    found = lambda group: F.regexp_extract_all("_text", pattern, F.lit(group))
    sized = F.zip_with(found(0), found(rule.group), lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("n")))
    placed = F.zip_with(sized, F.split("_text", rule.regex, -1), lambda x, gap: F.struct(F.length(gap).alias("gap"), x["size"].alias("size"), x["n"].alias("n")))
    every = F.filter(placed, lambda x: x["size"].isNotNull())  # behind the last match is a piece alone
    moved = lambda at, x: at + x["gap"] + x["size"]

    def span(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("s"), F.lit(order).alias("k"), moved(at, x).alias("e"), x["n"].alias("n"), F.lit(k).alias("kind"))

    def appended(state: Column, at: Column, item: Column) -> Column:
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    def of_block(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(SPANS).alias("out")), lambda a, x: appended(a, moved(a["at"], x), span(a["at"], x)), lambda a: a["out"])

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), moved))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: appended(a, a["at"] + x, a["at"]), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, of_block))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))
    spans = F.when(may, _named(every, lambda all_: F.when(F.size(all_) > 0, _named(cut(all_), of_blocks))))
    return df.withColumn(f"_sp_{k}", F.filter(F.coalesce(spans, F.array().cast(SPANS)), lambda x: x["n"] >= rule.least))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def find_secrets(docs: DataFrame, rules=BASE_RULES, added=ADDED_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_<kind> per base rule, base_spans, spans.

    ``base_spans`` and ``spans`` are "kind:start:end" by start, then kind in the rules'
    order; matches of one kind are leftmost and do not overlap; too short ones are dropped.
    """
    every = (*rules, *added)
    order = {r.kind: k for k, r in enumerate(every)}
    indexed = [r for r in every if trigram_clauses(r.regex)]
    texts = _texts(docs, id_col, text_col)
    spans = lambda some: [f"_sp_{r.kind}" for r in some]

    may = staged(candidates(texts, indexed))
    some = likely(texts, may, ["_id", "_key"]).dropDuplicates(["_id", "_key"]).alias("t")
    found = some.join(may.alias("m"), F.expr("t._id <=> m._id and t._key = m._key")).select("t.*", *(f"may_{r.kind}" for r in indexed))
    whole = texts
    for rule in every:
        if rule in indexed:
            found = _with_spans(found, rule, order[rule.kind], F.col(f"may_{rule.kind}"))
        else:
            whole = _with_spans(whole, rule, order[rule.kind], F.lit(True))
    found, whole = staged(found.select("_id", "_key", *spans(indexed))), whole.select("_id", "_key", *spans(r for r in every if r not in indexed))
    df = whole.alias("w").join(found.alias("f"), F.expr("w._id <=> f._id and w._key = f._key"), "left").select(
        "w._id", *(f"w._sp_{r.kind}" for r in every if r not in indexed), *(F.coalesce(f"f._sp_{r.kind}", F.array().cast(found.schema[f"_sp_{r.kind}"].dataType)).alias(f"_sp_{r.kind}") for r in indexed))
    return df.select(
        F.col("_id").alias(id_col),
        *(F.size(f"_sp_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules),
        _listed(F.concat(*(F.col(f"_sp_{r.kind}") for r in rules))).alias("base_spans"),
        _listed(F.concat(*(F.col(f"_sp_{r.kind}") for r in every))).alias("spans"),
    )
