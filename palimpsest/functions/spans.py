"""Spans of sensitive text as columns, and interval algebra on arrays of them.

A span is a struct (start, end, score, ord, type_id, source); start and end are byte offsets into the UTF-8 text, half-open.
Everything here is an expression of built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.entities import TYPE_ID
from palimpsest.functions.rules import DIGIT, SPACE, Rule, ending, translate

SPAN = "struct<start:int,end:int,score:float,ord:int,type_id:tinyint,source:string>"
NONE = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NONE)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step over the values so far, from 0 on, for each place of an array of ints.

    In chunks of about the square root of its size: a fold that appends copies what it has, so one over all would be quadratic.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def folded(chunk: Column) -> Column:
        return F.aggregate(chunk, start, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")))

    def joined(chunks: Column) -> Column:
        before = F.aggregate(chunks, start, lambda acc, c: F.struct(step(acc["at"], c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda x: step(b, x))))

    def over(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda at: folded(F.slice(v, at, width)))
        return F.when(F.size(v) > 0, bind(chunks, joined)).otherwise(F.array().cast("array<int>"))

    return bind(values, over)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def _folded(text: Column) -> Column:
    """In lower case; the one letter that folds to ASCII but does not lower to it goes too."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


_SIZES = "array<struct<skip:int,size:int>>"
_MATCHES = f"struct<score:float,ord:int,type_id:tinyint,sizes:{_SIZES}>"


def _matches(text: Column, folded: Column, rule: Rule, order: int, pattern: str) -> Column:
    """What a rule finds: for each match the bytes between the last one's span and its own, and its own."""
    if last := ending(rule):
        return bind(F.regexp_extract(text, last, 0), lambda part: _matches_in(part, folded, rule, order, pattern))
    return _matches_in(text, folded, rule, order, pattern)


def _matches_in(text: Column, folded: Column, rule: Rule, order: int, pattern: str) -> Column:

    def sized(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        gaps = F.slice(gaps, 1, F.size(values))
        if rule.group:
            labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            skips = F.zip_with(gaps, labels, lambda g, a: F.octet_length(g) + F.octet_length(a))
        else:  # the span is the whole match
            skips = F.transform(gaps, F.octet_length)
        sizes = F.zip_with(skips, values, lambda skip, v: F.struct(skip.alias("skip"), F.octet_length(v).alias("size")))
        return F.when(F.size(values) > 0, sizes)

    found = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), sized)
    if rule.guards:
        held = F.contains(folded, F.lit(rule.guards[0]))
        for guard in rule.guards[1:]:
            held = held | F.contains(folded, F.lit(guard))
        found = F.when(held, found)
    return F.struct(F.lit(rule.score).cast("float").alias("score"), F.lit(order).alias("ord"), F.lit(TYPE_ID[rule.kind]).cast("tinyint").alias("type_id"), found.alias("sizes"))


def _placed(matches: Column) -> Column:
    """Spans of an array of _matches; running sums give the byte offsets."""
    made = lambda m, start, end: F.struct(start.alias("start"), end.alias("end"), m["score"].alias("score"), m["ord"].alias("ord"), m["type_id"].alias("type_id"), F.lit("regex").alias("source"))
    ends = lambda m: running_sum(F.transform(m["sizes"], lambda x: x["skip"] + x["size"]))
    spans = lambda m: F.zip_with(ends(m), m["sizes"], lambda end, x: made(m, end - x["size"], end))
    found = F.filter(matches, lambda m: m["sizes"].isNotNull())
    return F.flatten(F.transform(found, spans)).cast(NONE)


def rule_spans(text: Column, rule: Rule, order: int, pattern: str | None = None) -> Column:
    """Spans of one rule."""
    return _placed(F.array(_matches(text, _folded(text), rule, order, pattern or translate(rule))))


def split_words(text: Column) -> Column:
    """(start, end, word) of all that stands between white space: the spans of \\S+ by two splits, which take a third of the time of a rule."""

    def placed(words: Column) -> Column:
        gaps = F.slice(F.split(text, f"[^{SPACE}]+", -1), 1, F.size(words))
        ends = running_sum(F.zip_with(gaps, words, lambda g, w: F.octet_length(g) + F.octet_length(w)))
        return F.zip_with(ends, words, lambda end, w: F.struct((end - F.octet_length(w)).alias("start"), end.alias("end"), w.alias("word")))

    return bind(F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != ""), placed)


def candidates(text: Column, rules: tuple[Rule, ...], min_score: float = 0.5) -> Column:
    """Spans of all rules that can reach the threshold, in the order of rules. Offsets are one expression for all rules."""
    live = [(i, r) for i, r in enumerate(rules) if r.score >= min_score]
    if not live:
        return no_spans()

    def found(folded: Column) -> Column:
        of = lambda digits: F.array(*[_matches(text, folded, r, i, translate(r)) for i, r in live if r.digits == digits]).cast(f"array<{_MATCHES}>")
        if not any(r.digits for _, r in live):
            return of(False)
        return F.concat(of(False), F.when(F.regexp_like(text, F.lit(f"[{DIGIT}]")), of(True)).otherwise(F.array().cast(f"array<{_MATCHES}>")))

    return _placed(bind(_folded(text), found))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def overlaps_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: overlaps(span, o))


def covered_by_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] <= span["start"]) & (o["end"] >= span["end"]))


def _ordered(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def sort_by_start(spans: Column) -> Column:
    """By start, then end, then order of recognition."""
    return _ordered(spans, lambda s: s["start"], lambda s: s["end"], lambda s: s["ord"])


def filter_by_score(spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: s["score"] >= F.lit(least).cast("float"))


def sanitized(spans: Column, text: Column) -> Column:
    """Without spans that are empty, beyond the text or of no known kind."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.octet_length(text)) & s["type_id"].between(1, len(TYPE_ID)))


def dedup_same_range(spans: Column) -> Column:
    """Of spans of one range the one of the highest score, of those the first recognised."""
    better = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & ((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["ord"] < b["ord"])))
    return sort_by_start(F.filter(spans, lambda s: ~F.exists(spans, lambda o: better(o, s))))


def _greedy(spans: Column) -> Column:
    """Greedy choice of disjoint spans: higher score, then longer, then earlier, then first recognised; by start."""
    best = _ordered(spans, lambda s: -s["score"], lambda s: s["start"] - s["end"], lambda s: s["start"], lambda s: s["ord"])
    taken = F.aggregate(best, no_spans(), lambda acc, s: F.when(overlaps_any(s, acc), acc).otherwise(F.concat(acc, F.array(s))))
    return sort_by_start(taken)


def resolved(spans: Column) -> Column:
    """Greedy choice of disjoint spans, by start. Spans that overlap directly or through others are one group; each group is judged by itself."""

    def grouped(s: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        groups = bind(heads, lambda h: F.transform(h, lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - at)))
        return F.flatten(F.transform(groups, lambda g: F.when(F.size(g) > 1, _greedy(g)).otherwise(g)))

    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest)
    judged = bind(sort_by_start(spans), lambda s: bind(reach(s), lambda r: grouped(s, r)))
    return F.when(F.size(spans) > 1, judged).otherwise(spans)


def normalized(spans: Column, least: float = 0.5) -> Column:
    """Disjoint spans of at least this score by start. Equal ranges need no step of their own: they overlap."""
    return bind(filter_by_score(spans, least), resolved)


def between(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with put(span, place) instead of each of the spans, which come by start."""
    end = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0))

    def rebuilt(data: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.concat(slice_of(data, end(i - 1), F.greatest(s["start"] - end(i - 1), F.lit(0))), put(s, i)))
        last = end(F.size(spans) - 1)
        return F.concat(F.array_join(pieces, ""), slice_of(data, last, F.octet_length(data) - last))

    return bind(text.cast("binary"), rebuilt)


def slice_of(data: Column, start: Column, size: Column) -> Column:
    """Bytes of binary data by offset, as text. Where many slices of a text are taken its bytes are bound first: the cast copies it."""
    return F.substring(data, start + 1, size).cast("string")


def slice_bytes(text: Column, start: Column, size: Column) -> Column:
    """Bytes of a text by offset, as text."""
    return slice_of(text.cast("binary"), start, size)
