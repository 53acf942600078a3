"""Rules that Spark's own functions can't run: a group within the pattern, or a validator that scores matches anew; and rules as a table function for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, arrow_udtf

from palimpsest.functions.entities import TYPE_ID
from palimpsest.functions.rules import WORD, PatternError, Rule, pieces, steady
from palimpsest.functions.spans import SPAN

Validator = Callable[[str, float], float]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32()), ("ord", pa.int32()), ("type_id", pa.int8()), ("source", pa.string())]))


def _spelt(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", pattern)


def compiled(rule: Rule) -> regex.Pattern:
    flags = re.match(r"\(\?[imsU]+\)", rule.pattern)
    core = rule.pattern[flags.end() :] if flags else rule.pattern
    left, right = core.startswith(r"\b"), bool(re.search(r"(?<!\\)(?:\\\\)*\\b$", core))
    core = core[2 if left else 0 : -2 if right else None]
    edge, core = ("", steady(core)[1]) if left or rule.group else steady(core)
    body = "".join(piece for piece, _ in pieces(core))
    body = _spelt((rf"(?:\G|(?<![{WORD}]))" if left else edge) + body + (rf"(?![{WORD}])" if right else ""))
    made = regex.compile((flags[0] if flags else "") + body, regex.V0)
    if rule.group > made.groups:
        raise PatternError(f"group {rule.group} of {rule.name} does not exist")
    return made


def scan_text(text: str, pattern: regex.Pattern, group: int) -> Iterator[tuple[int, int]]:
    """Spans by character; the scan goes on at the end of the span, one further if it is empty, and ends where its group has no part."""
    at = 0
    while at <= len(text) and (m := pattern.search(text, at)):
        start, end = m.span(group)
        if start < 0:
            return
        if start < end:
            yield start, end
        at = end if end > at else at + 1


def luhn(text: str, score: float) -> float:
    """A validator: a number whose check digit is wrong is worth half."""
    digits = [int(c) for c in text[::-1] if c.isdigit()]
    right = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    return score if right % 10 == 0 else score / 2


def live_rules(rules: list[Rule], order: int = 1000) -> list[tuple[int, Rule, regex.Pattern]]:
    return [(order + i, r, compiled(r)) for i, r in enumerate(rules)]


def scan(text: str, live: list[tuple[int, Rule, regex.Pattern]], validators: dict[str, Validator]) -> Iterator[tuple[int, int, float, int, int]]:
    """(start, end, score, ord, type_id) of what the rules find; places in bytes, counted on from one match to the next."""
    for place, rule, pattern in live:
        at = low = 0
        for start, end in scan_text(text, pattern, rule.group):
            low += len(text[at:start].encode())
            high = low + len(text[start:end].encode())
            score = validators[rule.name](text[start:end], rule.score) if rule.name in validators else rule.score
            yield low, high, score, place, TYPE_ID[rule.kind]
            at, low = end, high


def scan_rules(rules: list[Rule], validators: dict[str, Validator] | None = None, order: int = 1000) -> Callable[[Column], Column]:
    """A function of a text column that gives the spans of these rules, with scores from a rule's validator where it has one."""
    validators, live = validators or {}, live_rules(rules, order)

    @arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        fields = ("start", "end", "score", "ord", "type_id")
        return pa.array([[dict(zip(fields, found, strict=True)) | {"source": "regex"} for found in scan(text.as_py() or "", live, validators)] for text in texts], _SPANS)

    return spans


def register_spans(spark: SparkSession, name: str, rules: tuple[Rule, ...], validators: dict[str, Validator] | None = None) -> None:
    """A table function for SQL: name(TABLE(SELECT key, text ...)) gives a row for each span that the rules find.

    The argument's columns are a key of type long and a text. Rows are (key, start, end, score, ord, type_id), before any choice
    between spans; with the rules in the order of masking, operators.span_tables makes of them what masking would replace.
    """
    validators, live = validators or {}, live_rules(list(rules), 0)

    @arrow_udtf(returnType="key long, start int, end int, score float, ord int, type_id tinyint")
    class Spans:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, found, owners = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                own = list(scan(text.as_py() or "", live, validators))
                found += own
                owners += [i] * len(own)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.int32(), pa.int32(), pa.float32(), pa.int32(), pa.int8()))]
            yield pa.Table.from_arrays([keys.take(pa.array(owners, pa.int64())).cast(pa.int64()), *columns], names=["key", "start", "end", "score", "ord", "type_id"])

    spark.udtf.register(name, Spans)
