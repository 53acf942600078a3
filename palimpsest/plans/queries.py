"""Registered queries of the masking engine, each over a whole table, and equivalent SQL.

Queries of rules, language and credentials also run the inline cases of plans.cases, since the tables hold no such text; what
SQL can't express of them is compared with what must come of them.

The SQL finds spans with consuming boundaries, doubled separators standing in for look-around, and resolves overlaps by a
fold over each text's candidates.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.entities import ENTITIES, TYPE_ID, Switches
from palimpsest.functions.language import TRADITIONAL, detect, is_chinese
from palimpsest.functions.rules import RULES, SPACE, WORD, Rule
from palimpsest.functions.spans import SPAN, candidates, rule_spans
from palimpsest.operators.calls import call_frame
from palimpsest.operators.credentials import decode_credential, decode_json, encode_binary, encode_json
from palimpsest.operators.intervals import apart, covered, normalized_table, overlapping
from palimpsest.operators.fusion import with_fused
from palimpsest.operators.masking import ITEM, Options, mask_frame, restore_frame, restored, roundtrip_frame, span_frame
from palimpsest.operators.recognizing import recognizer
from palimpsest.plans import cases
from palimpsest.sources.texts import spread

_BY_NAME = {r.name: r for r in RULES}
TABLES = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id", "text"), "benchmark": ("item_id", "text")}


def _read(spark: SparkSession, sf_dir: str, table: str, *more: str) -> DataFrame:
    """Key, text and further columns of a table; nothing else is scanned."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*TABLES[table], *more))


_CASES = [text for text, _ in cases.MASKED]


def _with_cases(spark: SparkSession, sf_dir: str, first: int = -101, texts: list[str] = _CASES) -> DataFrame:
    """(doc_id, text) of documents, and inline texts."""
    return _read(spark, sf_dir, "documents").unionAll(cases.rows(spark, first, texts))


def rule_query(rule: Rule, table: str):
    """Spans of one rule; on documents with the inline cases."""
    key, text = TABLES[table]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _with_cases(spark, sf_dir) if table == "documents" else _read(spark, sf_dir, table).select(key, text)
        spans = df.select(key, F.explode_outer(rule_spans(F.col(text), rule, 0)).alias("s")).where("s IS NOT NULL")
        return spans.select(key, F.lit(rule.kind).alias("type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.round(F.col("s.score").cast("double"), 2).alias("score"))

    return query


def spans_query(table: str, switches: Switches | None = None):
    key, text = TABLES[table]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = span_frame(_read(spark, sf_dir, table).select(key, text), [key], text, Options(switches=switches or Switches()))
        return out.select(key, "id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round(F.col("score").cast("double"), 2).alias("score"), "span_text")

    return query


def mask_query(table: str, switches: Switches | None = None):
    key, text = TABLES[table]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table, *(["turn"] if table == "conversations" else [])).select(key, F.col(text).alias("text"), F.col("turn") if table == "conversations" else F.lit(0).alias("turn"))
        out = mask_frame(df, options=Options(switches=switches or Switches()))
        return out.select(key, F.col("turn").cast("long").alias("turn"), "masked", F.size("meta.items").cast("long").alias("n_items"))

    return query


def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked items by kind and language, with subtotals."""
    docs = _read(spark, sf_dir, "documents", "lang")
    spans = span_frame(docs, ["doc_id", "lang"])
    return spans.rollup("lang", "type").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("type", F.lit("*")).alias("type"), "n_spans", "n_docs")


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roundtrip_frame(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_items").cast("long").alias("n_items"), F.sha2("restored", 256).alias("restored_sha256"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_cases(spark, sf_dir, -201, [text for text, _ in cases.LANGUAGES])
    return docs.select("doc_id", detect(F.col("text")).alias("language")).withColumn("chinese", is_chinese(F.col("language")))


def mask_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the inline cases masked, and restored from what was masked."""
    out = roundtrip_frame(_with_cases(spark, sf_dir))
    return out.select("doc_id", "masked", F.sha2("restored", 256).alias("restored_sha256"))


def credential_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary credential of each text, in hex, and the id and text of each of its items read back."""
    out = mask_frame(_with_cases(spark, sf_dir))
    out = out.select("doc_id", encode_binary(F.col("meta")).alias("credential"))
    out = out.select("doc_id", F.hex(F.unbase64("credential")).alias("bytes"), decode_credential(F.col("credential")).alias("back"))
    return out.select("doc_id", "bytes", F.col("back.original").alias("held"), F.size("back.items").cast("long").alias("n_items"))


def _items(items: Column) -> Column:
    kind = lambda i: F.element_at(F.array(*[F.lit(k) for k in ENTITIES]), i["type_id"])
    return F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["type_id"].cast("tinyint").alias("type_id"), kind(i).alias("type"), i["start"].alias("start"), i["end"].alias("end"), F.lit(1.0).cast("float").alias("score"))).cast(f"array<{ITEM}>")


def restore_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies joined with the credentials of what was asked: each masked document with words around it, and the inline replies."""
    out = mask_frame(_read(spark, sf_dir, "documents"))
    given = [(-301 - i, reply, original, [tuple(x) for x in items]) for i, (reply, original, items, _) in enumerate(cases.RESTORED)]
    more = spark.createDataFrame(given, "doc_id long, reply string, original string, items array<struct<id:bigint,type_id:int,start:int,end:int>>")
    metas = out.select("doc_id", "meta").unionAll(more.select("doc_id", F.struct("original", _items(F.col("items")).alias("items"))))
    replies = out.select("doc_id", F.concat(F.lit("Re: "), "masked", F.lit(" (end)")).alias("reply")).unionAll(more.select("doc_id", "reply"))
    back = restore_frame(replies.where("reply IS NOT NULL"), metas, "doc_id")
    return back.select("doc_id", F.char_length("restored").cast("long").alias("n_chars"), F.sha2("restored", 256).alias("restored_sha256"))


def call_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model that repeats its prompt gets to see, and what comes back to the user."""
    out = call_frame(_read(spark, sf_dir, "documents").where("text IS NOT NULL"))
    return out.select("doc_id", F.sha2("reply", 256).alias("reply_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def address_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses fused from documents in Chinese and from the inline lines, each a piece of an address as a whole."""
    df = _with_cases(spark, sf_dir, -401, [text for text, _ in cases.ADDRESSES])
    whole = F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end"), F.lit(0.9).cast("float").alias("score"), F.lit(0).alias("ord"), F.lit(TYPE_ID["PHYSICAL_ADDRESS"]).cast("tinyint").alias("type_id"), F.lit("case").alias("source"))
    df = df.withColumn("spans", F.array(whole).cast(f"array<{SPAN}>")).withColumn("chinese", is_chinese(detect(F.col("text"))))
    found = with_fused(df, "made", "text", "spans", "chinese").select("doc_id", F.explode("made.addresses").alias("a"))
    return found.select("doc_id", F.col("a.start").cast("long").alias("start"), F.col("a.end").cast("long").alias("end"), F.round(F.col("a.score").cast("double"), 4).alias("score"))


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a token model on documents and the inline texts."""
    df = _with_cases(spark, sf_dir, -501, [text for text, _ in cases.TOKENS])
    found = df.select("doc_id", recognizer(cases.WORD_MODEL)(F.col("text"), F.lit("en")).alias("spans")).select("doc_id", F.explode("spans").alias("s"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ENTITIES]), F.col("s.type_id").cast("int"))
    return found.select("doc_id", kind.alias("type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _through(encode, decode, told: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = mask_frame(_read(spark, sf_dir, "documents").select("doc_id", "text"))
        out = out.select("doc_id", "masked", encode(F.col("meta")).alias("credential"))
        out = out.select("doc_id", "masked", "credential", decode(F.col("credential")).alias("meta"))
        back = restored(F.col("masked"), F.col("meta.original"), F.col("meta.items"))
        held = [F.sha2(F.unbase64("credential"), 256).alias("credential_sha256")] if told else []
        return out.select("doc_id", F.size("meta.items").cast("long").alias("n_items"), F.sha2(back, 256).alias("restored_sha256"), *held)

    return query


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that each masked text holds; more than its items if the text held some before, as the inline ones do."""
    out = mask_frame(_with_cases(spark, sf_dir, -701, cases.PLACEHOLDERS))
    return out.select("doc_id", F.size("meta.items").cast("long").alias("n_items"), F.regexp_count("masked", F.lit(r"__PII_[A-Z_]+_\d+__")).cast("long").alias("n_placeholders"))


def _interval_query(operator, left: str, right: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        one, two = (rule_query(_BY_NAME[n], "documents")(spark, sf_dir) for n in (left, right))
        return operator(one, two, ["doc_id"]).select("doc_id", "start", "end")

    return query


def normalized_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all rules as a table, then made disjoint. One scan finds them all."""
    spans = _with_cases(spark, sf_dir).select("doc_id", F.explode_outer(candidates(F.col("text"), RULES)).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")
    return normalized_table(spans, ["doc_id"]).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("type_id").cast("int").alias("type_id"))


NO_PHONE = Switches().disable("PHONE_NUMBER")
QUERIES = {
    "mask_documents": mask_query("documents"),
    "mask_pages": mask_query("pages"),
    "mask_conversations": mask_query("conversations"),
    "mask_without_phone": mask_query("documents", NO_PHONE),
    "spans_documents": spans_query("documents"),
    "spans_pages": spans_query("pages"),
    "roundtrip_documents": roundtrip,
    "credential_json": _through(encode_json, decode_json, True),
    "credential_binary": _through(encode_binary, decode_credential),
    "language_documents": languages,
    "span_counts": span_counts,
    "placeholders_documents": placeholders,
    "intervals_overlapping": _interval_query(overlapping, "PHONE", "BANK"),
    "intervals_apart": _interval_query(apart, "PHONE", "BANK"),
    "intervals_covered": _interval_query(covered, "BANK", "PHONE"),
    "intervals_normalized": normalized_rules,
    "mask_cases": mask_cases,
    "credential_bytes": credential_bytes,
    "restore_join": restore_join,
    "call_echo": call_echo,
    "address_fusion": address_fusion,
    "token_spans": token_spans,
}
QUERIES |= {f"rule_{r.name.lower()}": rule_query(r, "documents") for r in RULES}
QUERIES |= {f"rule_{n.lower()}_pages": rule_query(_BY_NAME[n], "pages") for n in ("EMAIL", "PHONE", "BANK", "VCODE")}

_CUT, _DOUBLE = "chr(64976)", "chr(64977)"


def _cases_sql(first: int = -101, texts: list[str] = _CASES) -> str:
    """documents and inline texts, as a source of a query."""
    return f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {cases.values(first, texts)}) v (doc_id, text))"


def _sql_pattern(rule: Rule) -> tuple[str, bool]:
    """The rule with three groups: before the span, the span, behind it; and whether separators must be doubled."""
    flags = "(?i)" if rule.pattern.startswith("(?i)") else ""
    core = rule.pattern[len(flags) :]
    left, right = core.startswith(r"\b"), core.endswith(r"\b")
    core = core[2 if left else 0 : -2 if right else None]
    core = core.replace(r"[\s\S]", "(?s:.)").replace(r"[\d -]", r"[\p{Nd} -]").replace(r"\d", r"[\p{Nd}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    core = core.replace("(seed|mnemonic)", "(?:seed|mnemonic)").replace("([a-z]+[", "(?:[a-z]+[")
    before, value = (core[: core.rindex("(")], core[core.rindex("(") + 1 : -1]) if rule.group else ("", core)
    edge = rf"(?:\A|[^{WORD}])" if left else ""
    return f"{flags}({edge}{before})({value})" + (rf"([^{WORD}]|\z)" if right else "()"), left


def _candidates_sql(table: str, rules: list[tuple[int, Rule]], keys: str, text: str) -> str:
    parts = []
    for order, rule in rules:
        pattern, doubled = _sql_pattern(rule)
        pattern = pattern.replace("'", "''")
        source = f"regexp_replace({text}, '([^{WORD}])', '\\1' || {_DOUBLE}, 'g')" if doubled else text
        if doubled:  # a doubled separator may also stand within a label
            pattern = pattern.replace(f"[{SPACE}]", rf"[{SPACE}\x{{FDD1}}]").replace(r"[:=\-]?", r"[:=\-\x{FDD1}]*").replace("[:=]", r"[:=]\x{FDD1}?").replace(r"[^\p{L}", r"[^\x{FDD1}\p{L}").replace(r"(?:\A|[^\x{FDD1}", r"(?:\A|[^")
        parts.append(
            f"SELECT {keys}, k.i AS i, {order} AS ord, {TYPE_ID[rule.kind]} AS type_id, '{rule.kind}' AS type, {rule.score} AS score, "
            f"CAST(strlen(replace(array_to_string(p[1:2*k.i-1], ''), {_DOUBLE}, '')) AS BIGINT) AS s, "
            f"CAST(strlen(replace(array_to_string(p[1:2*k.i], ''), {_DOUBLE}, '')) AS BIGINT) AS e "
            f"FROM (SELECT {keys}, string_split(regexp_replace({source}, '{pattern}', '\\1' || {_CUT} || '\\2' || {_CUT} || '\\3', 'g'), {_CUT}) AS p FROM {table}) t, "
            f"LATERAL (SELECT unnest(range(1, CAST((len(t.p) + 1) / 2 AS INT))) AS i) k WHERE len(t.p) > 1"
        )
    return "\nUNION ALL\n".join(parts)


def _rule_sql(rule: Rule, table: str) -> str:
    key, text = TABLES[table]
    source = f"{_cases_sql()} d" if table == "documents" else table
    return f'SELECT {key}, type, s AS "start", e AS "end", CAST(score AS DOUBLE) AS score FROM ({_candidates_sql(source, [(0, rule)], key, text)}) c'


def _resolved_sql(table: str, switches: Switches, keys: str, source: str | None = None, candidates: str | None = None) -> str:
    """(keys, id, type, s, e, score) of masked items of a table, or of another source with its columns, or of other candidates."""
    _, text = TABLES[table]
    enabled = ", ".join(str(i) for i, kind in enumerate(ENTITIES, 1) if switches.enabled(kind)) or "0"
    rules = [(i, r) for i, r in enumerate(RULES) if r.score >= 0.5]
    return f"""
SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY s) AS id, type, s, e, score FROM (
  SELECT {keys}, unnest(kept, recursive := true) FROM (
    SELECT {keys}, list_reduce(list(struct_pack(type := type, type_id := type_id, s := s, e := e, score := CAST(score AS DOUBLE)) ORDER BY score DESC, e - s DESC, s, ord),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: o.s < x[1].e AND x[1].s < o.e)) > 0 THEN acc ELSE list_concat(acc, x) END,
      CAST([] AS STRUCT("type" VARCHAR, type_id INTEGER, s BIGINT, e BIGINT, score DOUBLE)[])) AS kept
    FROM (SELECT {keys}, type, type_id, s, e, score, ord FROM ({candidates or _candidates_sql(source or table, rules, keys, text)}) c) GROUP BY {keys}))
WHERE type_id IN ({enabled})""".replace("list(struct_pack", "list([struct_pack").replace("CAST(score AS DOUBLE)) ORDER", "CAST(score AS DOUBLE))] ORDER")


def _spans_sql(table: str, switches: Switches | None = None) -> str:
    key, text = TABLES[table]
    return f"""WITH items AS ({_resolved_sql(table, switches or Switches(), key)})
SELECT i.{key}, i.id, i.type, i.s AS "start", i.e AS "end", i.score, decode(array_slice(encode(t.{text}), i.s + 1, i.e)) AS span_text
FROM items i JOIN {table} t ON i.{key} = t.{key}"""


def _mask_sql(table: str, switches: Switches | None = None, source: str | None = None) -> str:
    key, text = TABLES[table]
    turn = "turn" if table == "conversations" else "CAST(0 AS BIGINT)"
    keys = f"{key}, turn" if table == "conversations" else key
    on = " AND ".join(f"t.{k} = p.{k}" for k in keys.split(", "))
    each = ", ".join(f"i.{k}" for k in keys.split(", "))
    same = " AND ".join(f"i.{k} = d.{k}" for k in keys.split(", "))
    return f"""WITH items AS ({_resolved_sql(table, switches or Switches(), keys, source)}),
placed AS (
  SELECT {each}, count(*) AS n,
    string_agg(decode(array_slice(encode(d.{text}), i.before + 1, i.s)) || '__PII_' || i.type || '_' || i.id || '__', '' ORDER BY i.s) AS head, max(i.e) AS last
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS before FROM items) i JOIN {source or table} {'' if source else 'd'} ON {same} GROUP BY {each})
SELECT t.{key}, {f't.{turn}' if turn == 'turn' else turn} AS turn, CASE WHEN p.n IS NULL THEN t.{text} ELSE p.head || decode(array_slice(encode(t.{text}), p.last + 1, strlen(t.{text}))) END AS masked, coalesce(p.n, 0) AS n_items
FROM (SELECT * FROM {source or table}) t LEFT JOIN placed p ON {on}"""


_LANGUAGE_SQL = r"""
SELECT *, starts_with(language, 'zh') AS chinese FROM (SELECT doc_id, CASE
    WHEN kana > 0 AND kana * 4 >= kana + hangul + han + other THEN 'ja'
    WHEN hangul > 0 AND hangul * 4 >= kana + hangul + han + other THEN 'ko'
    WHEN han = 0 AND other = 0 THEN ''
    WHEN han = 0 OR han * 10 < other THEN 'en'
    WHEN traditional > 0 THEN 'zh-Hant' ELSE 'zh-Hans' END AS language
FROM (SELECT doc_id,
    len(regexp_extract_all(t, '[\p{Hiragana}\p{Katakana}\x{FF66}-\x{FF9D}]')) AS kana,
    len(regexp_extract_all(t, '\p{Hangul}')) AS hangul, len(regexp_extract_all(t, '\p{Han}')) AS han,
    len(regexp_extract_all(regexp_replace(t, '[\p{Hiragana}\p{Katakana}\x{FF66}-\x{FF9D}\p{Hangul}\p{Han}]', '', 'g'), '\p{L}')) AS other,
    len(regexp_extract_all(t, '[TRADITIONAL]')) AS traditional
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM SOURCE d)))
""".replace("TRADITIONAL", TRADITIONAL).replace("SOURCE", _cases_sql(-201, [text for text, _ in cases.LANGUAGES]))
_ITEMS_PER_DOC = f"SELECT t.doc_id, coalesce(n, 0) AS n_items, sha256(text) AS restored_sha256 FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_resolved_sql('documents', Switches(), 'doc_id')}) GROUP BY doc_id) i ON t.doc_id = i.doc_id"
_PLACED = _cases_sql(-701, cases.PLACEHOLDERS)
_JSON_SQL = f"""WITH items AS ({_resolved_sql('documents', Switches(), 'doc_id')}), told AS (
  SELECT doc_id, count(*) AS n, string_agg('{{"id":' || id || ',"type":' || list_position({list(ENTITIES)!r}, type) || ',"start":' || s || ',"end":' || e || ',"score":' || score || '}}', ',' ORDER BY id) AS items FROM items GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_items, sha256(text) AS restored_sha256, sha256('{{"original":' || coalesce(to_json(text), '""') || ',"items":[' || coalesce(items, '') || ']}}') AS credential_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id"""

SQL = {
    "mask_documents": _mask_sql("documents"),
    "mask_pages": _mask_sql("pages"),
    "mask_conversations": _mask_sql("conversations"),
    "mask_without_phone": _mask_sql("documents", NO_PHONE),
    "spans_documents": _spans_sql("documents"),
    "spans_pages": _spans_sql("pages"),
    "roundtrip_documents": _ITEMS_PER_DOC,
    "credential_json": _JSON_SQL,
    "credential_binary": _ITEMS_PER_DOC,
    "language_documents": _LANGUAGE_SQL,
    "span_counts": f"""WITH items AS (SELECT i.*, d.lang FROM ({_resolved_sql('documents', Switches(), 'doc_id')}) i JOIN documents d ON i.doc_id = d.doc_id)
SELECT coalesce(lang, '*') AS lang, coalesce(type, '*') AS type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM items GROUP BY ROLLUP (lang, type)""",
}


def _interval_sql(left: str, right: str, negated: str, meets: str) -> str:
    one, two = (_candidates_sql(f"{_cases_sql()} d", [(0, _BY_NAME[n])], "doc_id", "text") for n in (left, right))
    return f'SELECT a.doc_id, a.s AS "start", a.e AS "end" FROM ({one}) a WHERE {negated} EXISTS (SELECT 1 FROM ({two}) b WHERE a.doc_id = b.doc_id AND {meets})'


SQL |= {
    "placeholders_documents": f"""SELECT d.doc_id, coalesce(n, 0) AS n_items, coalesce(n, 0) + len(regexp_extract_all(d.text, '__PII_[A-Z_]+_[0-9]+__')) AS n_placeholders FROM {_PLACED} d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_resolved_sql("documents", Switches(), "doc_id", f"{_PLACED} d")}) GROUP BY doc_id) i ON i.doc_id = d.doc_id""",
    "intervals_overlapping": _interval_sql("PHONE", "BANK", "", "a.s < b.e AND b.s < a.e"),
    "intervals_apart": _interval_sql("PHONE", "BANK", "NOT", "a.s < b.e AND b.s < a.e"),
    "intervals_covered": _interval_sql("BANK", "PHONE", "", "b.s <= a.s AND b.e >= a.e"),
    "intervals_normalized": f'SELECT doc_id, s AS "start", e AS "end", CAST(list_position({list(ENTITIES)!r}, type) AS INTEGER) AS type_id FROM ({_resolved_sql("documents", Switches.all(), "doc_id", f"{_cases_sql()} d")}) i',
}


def _le(n: str) -> str:
    """A 32-bit number in hex, little-endian."""
    return f"regexp_replace(printf('%08X', {n}), '(..)(..)(..)(..)', '\\4\\3\\2\\1')"


_SCORE_HEX = " ".join(f"WHEN {w} THEN '{struct.pack('<f', w).hex().upper()}'" for w in sorted({r.score for r in RULES}))
_CREDENTIAL_SQL = f"""
WITH docs AS (SELECT * FROM {_cases_sql()} d), items AS ({_resolved_sql("documents", Switches(), "doc_id", f"{_cases_sql()} d")}),
cut AS (
  SELECT i.doc_id, i.id, i.score, CAST(list_position({list(ENTITIES)!r}, i.type) AS INTEGER) AS kind, e - s AS n, hex(array_slice(encode(text), s + 1, e)) AS bytes, decode(array_slice(encode(text), s + 1, e)) AS held
  FROM items i JOIN docs ON i.doc_id = docs.doc_id
), placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM cut
), packed AS (
  SELECT doc_id, count(*) AS k, CAST(sum(n) AS BIGINT) AS size, string_agg(bytes, '' ORDER BY id) AS text, string_agg(held, '' ORDER BY id) AS held,
    string_agg({_le("id")} || printf('%02X000000', kind) || {_le("CAST(place AS BIGINT)")} || {_le("CAST(place + n AS BIGINT)")} || CASE CAST(score AS DECIMAL(4, 2)) {_SCORE_HEX} END, '' ORDER BY id) AS records
  FROM placed GROUP BY doc_id
)
SELECT d.doc_id, {_le("12 + coalesce(size, 0) + 20 * coalesce(k, 0)")} || {_le("coalesce(size, 0)")} || coalesce(p.text, '') || repeat('00', CAST((4 - coalesce(size, 0) % 4) % 4 AS BIGINT)) || coalesce(records, '')
    || repeat('00', CAST(4 - (4 - coalesce(size, 0) % 4) % 4 AS BIGINT)) AS bytes, coalesce(held, '') AS held, coalesce(k, 0) AS n_items
FROM docs d LEFT JOIN packed p ON d.doc_id = p.doc_id
"""


def _expected(first: int, rows: list[tuple[int, str]], names: str) -> str:
    """What must come of inline cases: (number of the case, its columns in SQL)."""
    return f"SELECT * FROM (VALUES {', '.join(f'({first - i}, {columns})' for i, columns in rows)}) v (doc_id, {names})"


SQL |= {
    "mask_cases": f"""SELECT m.doc_id, masked, sha256(text) AS restored_sha256 FROM ({_mask_sql('documents')}) m JOIN documents d ON m.doc_id = d.doc_id
UNION ALL {_expected(-101, [(i, f"{cases.quoted(want)}, sha256({cases.quoted(text)})") for i, (text, want) in enumerate(cases.MASKED)], "masked, restored_sha256")}""",
    "credential_bytes": _CREDENTIAL_SQL,
    "restore_join": f"""SELECT doc_id, length(t) AS n_chars, sha256(t) AS restored_sha256 FROM (
SELECT doc_id, 'Re: ' || text || ' (end)' AS t FROM documents WHERE text IS NOT NULL UNION ALL {_expected(-301, [(i, cases.quoted(want)) for i, (*_, want) in enumerate(cases.RESTORED)], "t")})""",
    "call_echo": f"SELECT m.doc_id, sha256(masked) AS reply_sha256, sha256(text) AS restored_sha256 FROM ({_mask_sql('documents')}) m JOIN documents d ON m.doc_id = d.doc_id WHERE text IS NOT NULL",
    "address_fusion": _expected(-401, [(i, f"CAST({s} AS BIGINT), CAST({e} AS BIGINT), CAST({w} AS DOUBLE)") for i, (_, found) in enumerate(cases.ADDRESSES) for w, s, e in found], '"start", "end", score'),
    "token_spans": _expected(-501, [(i, f"'{kind}', CAST({s} AS BIGINT), CAST({e} AS BIGINT)") for i, (_, found) in enumerate(cases.TOKENS) for kind, s, e in found], 'type, "start", "end"'),
}
SQL |= {f"rule_{r.name.lower()}": _rule_sql(r, "documents") for r in RULES}
SQL |= {f"rule_{n.lower()}_pages": _rule_sql(_BY_NAME[n], "pages") for n in ("EMAIL", "PHONE", "BANK", "VCODE")}
