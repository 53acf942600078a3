"""Personal data in texts, disguised or not, at its place in the source.

Plain identifiers are found in the text as it stands. Three transducers then rewrite what may disguise one, each into a text and a
table of its edits, by which places lead back:

* homoglyphs: characters that look like ASCII ones become these, and characters without width go;
* spelled digits: runs of three or more number words in English, German, French or Spanish become digits, also with `double` and
  `triple`, and a `plus` before them; what separates the words goes;
* disguises of @ and dot, in brackets, in words, with spaces, as character references: only where the parts of an address stand
  around them, and where a bare `at` is followed by a domain whose dots are disguised as well; dots between the numbers of an
  IPv4 address. Of a local part so disguised, up to 80 characters before the @ are looked at.

What the same detectors find in the rewritten text is led back through the tables to places in the source: a span reaches from the
first to the last source character that its own characters come from. It is added if no plain span holds it. Spans count code
points, end exclusive; base says that a span is plain. The query's counts are those of plain spans.

Every pattern takes time in proportion to a text's length. Texts without any candidate are told by one scan of a batch.

Defined results: null and empty texts have no spans; repeated rows, extra columns and rows without id come back as they are; names
that clash with the result's are an error; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Which texts of a batch are worth a look: anything that could be plain, anything that could be a disguise.
_PLAIN = r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9][ ().0-9-]{8}|[0-9](?:[ -]?[0-9]){13}"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next: what stands before it back to the last span, and a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            yield low, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if c.isdigit())


def detect(text: str) -> list[Span]:
    """Plain identifiers, by start and then kind."""
    out = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part) < 4 or not part[:-3].strip("0") for part in m[0].split(".")) and all(int(part[-3:]) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


class Edits:
    """A text rewritten at some places, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, at, self.made, self.held = [], 0, [], []
        size = 0
        for start, end, put in edits:
            pieces += (text[at:start], put)
            size += start - at
            self.made.append((size, size + len(put)))
            self.held.append((start, end))
            size += len(put)
            at = end
        self.text = "".join([*pieces, text[at:]])
        self.starts = [s for s, _ in self.made]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Where the characters of a span come from."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at, at + 1
        low, high = self.made[k]
        if at < high:
            return self.held[k]
        at += self.held[k][1] - high
        return at, at + 1


# Letters that look like the ASCII letters below them.
_ALIKE = str.maketrans(
    "АВЕКМНОРСТУХІЈЅԌԚԜаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυɑɡıℓ。∙․•٠۰",
    "ABEKMHOPCTYXIJSGQWaeopcyxijsdqwhlABEZHIKMNOPTYXoavipuagil....00",
)
_DASHES = "‐‑‒–−﹣"


def _homoglyphs() -> tuple[dict[int, str], re.Pattern, str]:
    """Characters and the ASCII character that each stands for; a pattern of those without width; one of all, for a batch."""
    alike = {code: chr(to) for code, to in _ALIKE.items()} | {ord(c): "-" for c in _DASHES}
    nothing = []
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        if unicodedata.category(c) == "Cf" and unicodedata.bidirectional(c) == "BN":
            nothing.append(c)
        elif code not in alike:
            digit = unicodedata.decimal(c, None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and " " <= plain <= "~":
                alike[code] = plain
    spelt = "".join(rf"\x{{{code:X}}}" for code in sorted([*alike, *map(ord, nothing)]))
    return alike, re.compile(f"[{''.join(nothing)}]+"), f"[{spelt}]"


_LOOKS, _WIDTHLESS, _ANY_LOOK = _homoglyphs()


def homoglyphs(text: str) -> Edits:
    """One for one, so that places stay; but for characters without width, which go."""
    return Edits(text.translate(_LOOKS), [] if text.isascii() else [(*m.span(), "") for m in _WIDTHLESS.finditer(text)])


# Number words, from nought to nine.
_NUMBERS = (
    ("zero", "null", "zéro", "cero", "oh"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
_DIGIT_OF = {word: str(n) for n, words in enumerate(_NUMBERS) for word in words}
_WORD = "|".join(sorted(_DIGIT_OF, key=lambda w: (-len(w), w)))
_TIMES = {"double": 2, "triple": 3}
_DOT_WORDS = ("dot", "point", "punkt", "punto")
_DOT_WORD = "|".join(_DOT_WORDS)
_NUMBER = rf"(?:(?:double|triple)[ -])?(?:{_WORD}|[0-9]++)(?![^\W_])"
_GAP = rf"(?:, ?|[ -]| (?:{_DOT_WORD}) )"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[ -])?+{_NUMBER}(?:{_GAP}{_NUMBER}){{2,}}+", re.I)
_TOKEN = re.compile(rf"plus[ -]|{_NUMBER}|{_GAP}", re.I)


def spelled_digits(text: str) -> Edits:
    edits = []
    for run in _RUN.finditer(text):
        parts = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text, *run.span())]
        spoken = [bool(p[2].strip("0123456789 ,-")) and p[2].strip(" ") not in _DOT_WORDS for p in parts]
        if not any(spoken):
            continue
        for i, (start, end, part) in enumerate(parts):
            if part.startswith("plus"):
                edits.append((start, end, "+"))
            elif spoken[i]:
                *times, word = re.split("[ -]", part)
                edits.append((start, end, _DIGIT_OF.get(word, word) * (_TIMES[times[0]] if times else 1)))
            elif part.strip(" ,-") == "" and spoken[i - 1] and spoken[i + 1]:
                edits.append((start, end, ""))
            elif "," in part:
                edits.append((start, end, " "))
    return Edits(text, edits)


_OPEN, _SHUT = r" ?[\[({<] ?", r" ?[\])}>] ?"
_REFERENCE = r"&#0*{0};|&#[xX]0*{1};|&{2};"
_AT_SIGN = _REFERENCE.format(64, "40", "commat")
_DOT_SIGN = _REFERENCE.format(46, "2[eE]", "period")
#: Disguises of @ that need nothing more, and a bare word, which needs a domain with disguised dots.
_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{_OPEN}(?:at|@|arroba){_SHUT}|{_AT_SIGN}| @ | ?@ ?|(?P<word> at | arroba |_at_))(?=[A-Za-z0-9])", re.I)
_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}|{_DOT_SIGN}| (?:{_DOT_WORD}) | \. |_dot_)"
_ANY_DOT = rf"(?:\.|{_DOT})"
_DOTS = re.compile(_DOT, re.I)
_DOMAIN_LIKE = re.compile(rf"[A-Za-z0-9-]++(?:{_ANY_DOT}[A-Za-z0-9-]++)++", re.I)
_LOCAL_LIKE = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+)+\Z", re.I)
_IP_LIKE = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_ANY_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_SPLIT = re.compile(_ANY_DOT, re.I)
_LOCAL_REACH = 80


def _spoken(domain: str, dots: int) -> bool:
    """Whether a domain can stand behind a bare word: all its dots are disguised, and no part is such a word itself."""
    parts = _SPLIT.split(domain)
    return len(parts) == dots + 1 and len(parts[-1]) > 1 and parts[-1].isalpha() and not any(p.lower() in _DOT_WORDS for p in parts)


def at_and_dot(text: str) -> Edits:
    edits: dict[int, tuple[int, int, str]] = {}
    done = 0
    for m in _AT.finditer(text):
        domain = _DOMAIN_LIKE.match(text, m.end())
        if not domain or m.start() < done:
            continue
        dots = [d.span() for d in _DOTS.finditer(text, *domain.span())]
        if m["word"] and not _spoken(domain[0], len(dots)):
            continue
        if m[0].strip() == "@" and m[0] != "@" and not dots:
            continue  # spaces alone
        low = max(done, m.start() - _LOCAL_REACH)
        local = _LOCAL_LIKE.search(text[low : m.start()])
        if local:
            dots += [(low + d.start(), low + d.end()) for d in _DOTS.finditer(text[low : m.start()], local.start())]
        edits |= {s: (s, e, ".") for s, e in dots} | ({m.start(): (*m.span(), "@")} if m[0] != "@" else {})
        done = domain.end()
    for m in _IP_LIKE.finditer(text):
        edits |= {d.start(): (*d.span(), ".") for d in _DOTS.finditer(text, *m.span())}
    return Edits(text, _apart(sorted(edits.values())))


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without those that begin within the one before."""
    out: list[tuple[int, int, str]] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)
_DISGUISE = rf"(?i:(?:{_WORD})[ ,-]{{1,2}}(?:{_WORD}|double|triple|[0-9]|{_DOT_WORD})|{_DOT}|{_OPEN}(?:at|@|arroba){_SHUT}|{_AT_SIGN})"


def spans_of(text: str, disguised: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, kind and end."""
    base = detect(text)
    out = [(*s, True) for s in base]
    if disguised:
        steps = []
        for transducer in TRANSDUCERS:
            steps.append(transducer(steps[-1].text if steps else text))
        if steps[-1].text != text:
            found = set()
            for kind, start, end in detect(steps[-1].text):
                for step in reversed(steps):
                    start, end = step.source(start, end)
                found.add((kind, start, end))
            out += [(*s, False) for s in _outside(sorted(found, key=lambda s: s[1:]), sorted((s, e) for _, s, e in base))]
    return sorted(out, key=_order)


def _outside(found: list[Span], plain: list[tuple[int, int]]) -> Iterator[Span]:
    """Those, by start, that lie within no plain span."""
    at, reach = 0, -1
    for kind, start, end in found:
        while at < len(plain) and plain[at][0] <= start:
            reach = max(reach, plain[at][1])
            at += 1
        if reach < end:
            yield kind, start, end


def _spans(texts: pa.Array) -> pa.Array:
    look = lambda pattern: pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    disguised = pc.or_(look(_DISGUISE), look(_ANY_LOOK))
    worth = pc.or_(disguised, look(_PLAIN)).to_pylist()
    out = []
    for i, (text, some) in enumerate(zip(texts, worth)):
        found = spans_of(text.as_py(), disguised[i].as_py()) if some else []
        out.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found])
    return pa.array(out, _SPANS)


def identifiers(text: Column) -> Column:
    """Spans of a text, by start, kind and end."""
    return arrow_udf(_spans, SPANS)(text)


def with_identifiers(df: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """df with the spans of each text."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"a column {name} exists already: name the result otherwise")
    return df.withColumn(name, identifiers(F.col(text_col)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of spans that overlap, the kind of the first and the place of all."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text) - acc["at"], F.lit(0)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_identifiers(docs, name="found").drop("text")
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _kind_sql(kind: str, pattern: str, fits: str) -> str:
    """Spans of one kind, in SQL. Matches are cut out between marks; m is one of them."""
    return f"""SELECT doc_id, n, '{kind}' AS kind, {KINDS.index(kind)} AS k, length(array_to_string(p[1:2 * i - 1], '')) AS s, length(array_to_string(p[1:2 * i], '')) AS e
  FROM (SELECT doc_id, n, p, unnest(range(1, CAST((len(p) + 1) / 2 AS INT))) AS i FROM (
    SELECT doc_id, n, string_split(regexp_replace(text, '({pattern})', chr(64976) || '\\1' || chr(64976), 'g'), chr(64976)) AS p FROM docs) WHERE len(p) > 1)
  WHERE {fits.replace("m.", "p[2 * i]")}"""


_DIGITS_SQL = "regexp_replace(m., '[^0-9]', '', 'g')"
#: For documents as the tables have them, in which nothing is disguised.
OP12_SQL = (
    """WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents), spans AS (
"""
    + "\nUNION ALL ".join(
        [
            _kind_sql("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true"),
            _kind_sql("ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "len(list_filter(string_split(m., '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
            _kind_sql("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda j: CAST({_DIGITS_SQL}[-j] AS INT) * (2 - j % 2) - CASE WHEN j % 2 = 0 AND CAST({_DIGITS_SQL}[-j] AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"),
            _kind_sql("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 10 AND 15"),
        ]
    )
    + """), told AS (
  SELECT n, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip,
    count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone FROM spans GROUP BY n
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN told t ON t.n = d.n"""
)
