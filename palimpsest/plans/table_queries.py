"""Registered queries over spans in rows, streams, windows and sketches, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.entities import ENTITIES, TYPE_ID, Switches
from palimpsest.functions.rules import RULES, SPACE
from palimpsest.functions.spans import bind, candidates, dedup_same_range, split_words
from palimpsest.operators.leaks import leaks
from palimpsest.operators.masking import Options, lookup, mask_frame, span_frame
from palimpsest.operators.scanning import luhn, register_spans
from palimpsest.operators.span_tables import item_table, mask_from_spans, sanitized_table
from palimpsest.operators.tag_runs import entities
from palimpsest.operators.value_counts import distinct_sketches, merged, top_values
from palimpsest.plans import cases
from palimpsest.plans.queries import _candidates_sql, _cases_sql, _mask_sql, _read, _resolved_sql, _with_cases, mask_query
from palimpsest.sources.batches import JsonBatches
from palimpsest.sources.scratch import scratch_folder
from palimpsest.streaming.counts import session_counts, windowed_counts
from palimpsest.streaming.restoring import left_out, restore_replies, start_restoring

_LEAK_TEXTS = [text for pair in cases.LEAKS for text in pair]
_PATCH = {"maskAll": False, "maskEmail": True, "maskBankNumber": True, "maskUrl": None}
_LONGEST = 2000


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all rules on documents, as rows."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode_outer(candidates(F.col("text"), RULES)).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")


def from_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked from a table of all candidates."""
    out = mask_from_spans(_read(spark, sf_dir, "documents"), _found(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.lit(0).cast("long").alias("turn"), "masked", F.size("meta.items").cast("long").alias("n_items"))


def spans_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates of one range, the one that counts."""
    spans = _with_cases(spark, sf_dir).select("doc_id", F.explode_outer(bind(candidates(F.col("text"), RULES), dedup_same_range)).alias("s")).where("s IS NOT NULL")
    return spans.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.type_id").cast("int").alias("type_id"))


def spans_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates moved behind where they were found: those that are still within their texts."""
    spans, docs = _found(spark, sf_dir), _read(spark, sf_dir, "documents")
    moved = spans.withColumn("start", F.col("start") * 2 - 100).withColumn("end", F.col("end") * 2 - 100)
    return sanitized_table(docs, moved, ["doc_id"]).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("type_id").cast("int").alias("type_id"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind each placeholder's number, and behind the number after the last one."""
    out = mask_frame(_read(spark, sf_dir, "documents")).select("doc_id", "meta")
    held = F.transform(F.sequence(F.lit(1), F.size("meta.items") + 1), lambda n: F.struct(n.cast("long").alias("id"), lookup(F.col("meta.original"), F.col("meta.items"), n.cast("long")).alias("held")))
    return out.select("doc_id", F.explode_outer(held).alias("x")).select("doc_id", "x.id", "x.held")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text masked or refused, with the error; texts of more than 2,000 bytes are too long here."""
    out = mask_frame(_with_cases(spark, sf_dir).unionAll(spark.createDataFrame([(-199, None)], "doc_id long, text string")), error_col="error", max_bytes=_LONGEST)
    return out.select("doc_id", "masked", F.coalesce(F.size("meta.items"), F.lit(0)).cast("long").alias("n_items"), F.concat_ws(" ", "error.code", "error.message").alias("error"))


def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents written as JSON batches and read back; where each stands in its batch is left out."""
    spark.dataSource.register(JsonBatches)
    folder = scratch_folder(spark, "batches")
    out = mask_frame(_with_cases(spark, sf_dir)).select(F.col("masked").alias("text"), F.col("doc_id").cast("string").alias("maskMeta"))
    out.write.format("json_batches").mode("append").save(folder)
    return spark.read.format("json_batches").load(folder).select(F.col("maskMeta").cast("long").alias("doc_id"), F.col("text").alias("masked"))


def restore_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as two streams, of credentials and of replies; documents without an item have no credential."""
    folder = scratch_folder(spark, "restore")
    docs = _read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Masked once: both streams, and what is restored as a table, read what was written.
    asked = mask_frame(docs).select("doc_id", F.timestamp_seconds("doc_id").alias("masked_at"), "masked", "meta")
    asked.write.option("compression", "zstd").parquet(f"{folder}/asked")
    table = spark.read.schema(asked.schema).parquet(f"{folder}/asked")
    stream = lambda: spark.readStream.schema(table.schema).parquet(f"{folder}/asked")
    credentials = lambda df: df.where(F.size("meta.items") > 0).select("doc_id", "masked_at", "meta")
    replies = lambda df: df.select("doc_id", (F.col("masked_at") + F.expr("INTERVAL 5 MINUTES")).alias("replied_at"), F.concat(F.lit("Re: "), "masked").alias("reply"))
    start_restoring(replies(stream()), credentials(stream()), "doc_id", f"{folder}/out", f"{folder}/checkpoint", reach="1 hour", delay="1 minute").awaitTermination()
    kept = ["doc_id", "restored", "found"]
    done = spark.read.parquet(f"{folder}/out").select(*kept)
    # Replies that still wait in the state when the input ends are restored as a table.
    rest = restore_replies(left_out(replies(table), done, ["doc_id"]), credentials(table), "doc_id", reach="1 hour").select(*kept)
    return done.unionAll(rest).select("doc_id", F.sha2("restored", 256).alias("restored_sha256"), "found")


def _timed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked items at the time of the event of their document's number."""
    items = span_frame(_read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "type")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), "ts")
    return items.join(events, "doc_id")


def _more() -> list:
    return [F.count_distinct("doc_id").alias("n_docs")]


def _told(counts: DataFrame) -> DataFrame:
    spelt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return counts.select(spelt("window_start"), spelt("window_end"), "type", "n", "n_docs")


def items_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(windowed_counts(_timed_items(spark, sf_dir), "ts", ["type"], "6 hours", more=_more()))


def items_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(windowed_counts(_timed_items(spark, sf_dir), "ts", ["type"], "1 day", "6 hours", more=_more()))


def items_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(session_counts(_timed_items(spark, sf_dir), "ts", ["type"], "1 hour", more=_more()))


def spans_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by the table function in SQL, with a validator, chosen as masking would."""
    register_spans(spark, "palimpsest_spans", RULES, {"BANK": luhn})
    docs = _read(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("palimpsest_documents")
    found = spark.sql("SELECT key AS doc_id, start, end, score, ord, type_id FROM palimpsest_spans(TABLE(SELECT doc_id, text FROM palimpsest_documents))")
    items = item_table(docs, found, ["doc_id"])
    return items.select("doc_id", "id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round(F.col("score").cast("double"), 2).alias("score"))


def leaked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values masked in one document or inline text that stand in another."""
    masks = mask_frame(_with_cases(spark, sf_dir, -601, _LEAK_TEXTS))
    return leaks(masks, ["doc_id"]).select("doc_id", "type", F.sha2("value", 256).alias("value_sha256"), "n_items")


def tag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words with tags by their letters, in place of a model's: a capital opens a name, digits open a number; what goes on, and joins, by further letters."""
    docs = _read(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.posexplode_outer(split_words(F.col("text"))).alias("place", "t")).where("t IS NOT NULL").select("doc_id", "place", "t.*")
    kind = F.expr("CASE WHEN word RLIKE '^[A-ZÀ-Þ]' OR word RLIKE '^(de|la|of)$' THEN 'USER_NAME' WHEN word RLIKE '[0-9]' THEN 'PAYMENT' END")
    tagged = tokens.select("doc_id", "place", "start", "end", kind.alias("type"), F.expr("word RLIKE '^[A-ZÀ-Þ0-9+]'").alias("opens"), F.expr("word RLIKE '[.,]$'").alias("joined"), (F.char_length("word") / 32).alias("score"))
    found = entities(tagged, ["doc_id"], dense=True)
    return found.select("doc_id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_tokens", F.round(F.col("score").cast("double"), 4).alias("score"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "lang", "source")
    return span_frame(docs, ["lang", "source"]).select("lang", "source", "type", F.col("span_text").alias("value"))


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different values a kind: exactly, and whether the sketches of every language and source, merged, come within 5 %."""
    values = _values(spark, sf_dir)
    folder = scratch_folder(spark, "sketches")
    distinct_sketches(values, ["type", "lang", "source"], "value").write.parquet(folder)
    exact = values.groupBy("type").agg(F.count_distinct("value").alias("n_values"))
    near = merged(spark.read.parquet(folder), ["type"]).withColumnRenamed("n_values", "estimate")
    return exact.join(near, "type").select("type", "n_values", (F.abs(F.col("estimate") - F.col("n_values")) <= 0.05 * F.col("n_values")).alias("close"))


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty values that are masked most often."""
    return top_values(_values(spark, sf_dir), "value", 20).select(F.sha2("value", 256).alias("value_sha256"), "n")


QUERIES = {
    "mask_from_spans": from_spans,
    "mask_patched": mask_query("documents", Switches().patched(_PATCH)),
    "spans_deduped": spans_deduped,
    "spans_sanitized": spans_sanitized,
    "lookup_items": lookups,
    "envelope_documents": envelopes,
    "json_batches": json_batches,
    "restore_stream": restore_stream,
    "items_tumbling": items_tumbling,
    "items_sliding": items_sliding,
    "items_sessions": items_sessions,
    "spans_function": spans_function,
    "leaked_values": leaked_values,
    "tag_runs": tag_runs,
    "distinct_values": distinct_values,
    "top_values": frequent_values,
}

_ALL = [(i, r) for i, r in enumerate(RULES) if r.score >= 0.5]
_ITEMS = _resolved_sql("documents", Switches(), "doc_id")
_CUT = "decode(array_slice(encode(d.text), i.s + 1, i.e))"
_LONG = "CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", CAST(type_id AS INTEGER) AS type_id"
_TIMED = f"SELECT i.doc_id, i.type, v.ts FROM ({_ITEMS}) i JOIN events v ON v.event_id = i.doc_id"
_SPELT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_WITH_LEAKS = _cases_sql(-601, _LEAK_TEXTS)
_VALUES = f"SELECT i.type, {_CUT} AS value FROM ({_ITEMS}) i JOIN documents d ON d.doc_id = i.doc_id"


def _windows_sql(width: int, slide: int) -> str:
    """Windows of so many hours, which begin every `slide` hours."""
    steps = width // slide
    start = f"to_timestamp((epoch_us(ts) // {slide * 3600 * 10**6} - k) * {slide * 3600})"
    return f"""SELECT {_SPELT.format('w')} AS window_start, {_SPELT.format(f"w + INTERVAL {width} HOUR")} AS window_end, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT *, {start} AT TIME ZONE 'UTC' AS w FROM ({_TIMED}) t, (SELECT unnest(range(0, {steps})) AS k)) GROUP BY w, type"""


_BANK = next(i for i, r in _ALL if r.name == "BANK")
_LUHN = "list_sum(list_transform(range(1, length(value) + 1), lambda j: CAST(value[-j] AS INT) * (2 - j % 2) - CASE WHEN j % 2 = 0 AND CAST(value[-j] AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
_VALID = f"""(SELECT c.* FROM ({_candidates_sql('documents', _ALL, 'doc_id', 'text')}) c LEFT JOIN documents d ON c.ord = {_BANK} AND d.doc_id = c.doc_id
  WHERE c.ord <> {_BANK} OR (SELECT {_LUHN} FROM (SELECT decode(array_slice(encode(d.text), c.s + 1, c.e)) AS value)))"""
_TAGGED = f"""
SELECT doc_id, i AS place, s, e, CASE WHEN regexp_matches(word, '^[A-ZÀ-Þ]') OR regexp_matches(word, '^(de|la|of)$') THEN 'USER_NAME' WHEN regexp_matches(word, '[0-9]') THEN 'PAYMENT' END AS type,
  regexp_matches(word, '^[A-ZÀ-Þ0-9+]') AS opens, regexp_matches(word, '[.,]$') AS joined, CAST(length(word) / 32 AS FLOAT) AS score
FROM (
  SELECT doc_id, i, word, CAST(sum(strlen(gap) + strlen(word)) OVER w AS BIGINT) AS e, CAST(sum(strlen(gap) + strlen(word)) OVER w - strlen(word) AS BIGINT) AS s FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS word, unnest(string_split_regex(text, '[^{SPACE}]+')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '[^{SPACE}]+'), 1) AS i FROM documents)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

SQL = {
    "mask_from_spans": _mask_sql("documents"),
    "mask_patched": _mask_sql("documents", Switches.none().enable("EMAIL_ADDRESS").enable("BANK_NUMBER")),
    "spans_deduped": f"SELECT doc_id, {_LONG} FROM ({_candidates_sql(f'{_cases_sql()} d', _ALL, 'doc_id', 'text')}) c QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY score DESC, ord) = 1",
    "spans_sanitized": f"""SELECT c.doc_id, s * 2 - 100 AS start, e * 2 - 100 AS "end", CAST(type_id AS INTEGER) AS type_id
FROM ({_candidates_sql('documents', _ALL, 'doc_id', 'text')}) c JOIN documents d ON d.doc_id = c.doc_id WHERE s * 2 - 100 >= 0 AND e * 2 - 100 <= strlen(d.text)""",
    "lookup_items": f"""WITH items AS ({_ITEMS})
SELECT d.doc_id, i.id, {_CUT} AS held FROM items i JOIN documents d ON d.doc_id = i.doc_id
UNION ALL SELECT d.doc_id, coalesce(max(i.id), 0) + 1 AS id, NULL AS held FROM documents d LEFT JOIN items i ON d.doc_id = i.doc_id GROUP BY d.doc_id""",
    "envelope_documents": f"""WITH rows AS (SELECT * FROM {_cases_sql()} d UNION ALL SELECT -199, NULL), documents AS (SELECT * FROM rows WHERE strlen(text) <= {_LONGEST})
SELECT doc_id, masked, n_items, '' AS error FROM ({_mask_sql('documents')}) m
UNION ALL SELECT doc_id, NULL, 0, CASE WHEN text IS NULL THEN '400 no text' ELSE '413 text too long' END FROM rows WHERE text IS NULL OR strlen(text) > {_LONGEST}""",
    "json_batches": f"SELECT doc_id, masked FROM ({_mask_sql('documents', source=f'{_cases_sql()} d')}) m",
    "restore_stream": f"SELECT d.doc_id, sha256('Re: ' || text) AS restored_sha256, coalesce(n, 0) > 0 AS found FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_ITEMS}) GROUP BY doc_id) i ON i.doc_id = d.doc_id WHERE text IS NOT NULL",
    "items_tumbling": _windows_sql(6, 6),
    "items_sliding": _windows_sql(24, 6),
    "items_sessions": f"""WITH timed AS ({_TIMED}), opened AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY type ORDER BY ts) > INTERVAL 1 HOUR, true) AS opens FROM timed
), numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM opened)
SELECT {_SPELT.format('min(ts)')} AS window_start, {_SPELT.format("max(ts) + INTERVAL 1 HOUR")} AS window_end, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM numbered GROUP BY type, k""",
    "spans_function": f"""SELECT doc_id, id, type, s AS start, e AS "end", score FROM ({_resolved_sql('documents', Switches(), 'doc_id', candidates=_VALID)}) i""",
    "leaked_values": f"""WITH docs AS (SELECT * FROM {_WITH_LEAKS} d), items AS ({_resolved_sql('documents', Switches(), 'doc_id', f'{_WITH_LEAKS} d')}),
vals AS (SELECT type, value, count(*) AS n_items FROM (SELECT i.type, {_CUT} AS value FROM items i JOIN docs d ON d.doc_id = i.doc_id) WHERE length(value) >= 4 AND regexp_matches(value, '[\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]') GROUP BY ALL),
masks AS ({_mask_sql('documents', source=f'{_WITH_LEAKS} d')}),
near AS (SELECT m.doc_id, m.masked, v.* FROM masks m JOIN vals v ON contains(m.masked, v.value)),
edged AS (SELECT *, CASE WHEN regexp_matches(value[1], '[\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]') THEN '(^|[^\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])' ELSE '' END AS l,
  CASE WHEN regexp_matches(value[-1], '[\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]') THEN '([^\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|$)' ELSE '' END AS r FROM near)
SELECT doc_id, type, sha256(value) AS value_sha256, n_items FROM edged WHERE regexp_matches(masked, '(?s)' || l || regexp_escape(value) || r)""",
    "tag_runs": f"""WITH tokens AS ({_TAGGED}), broken AS (
  SELECT *, CAST(type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS b FROM tokens
), stretched AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY place) AS stretch FROM broken
), judged AS (
  SELECT *, opens AND (NOT joined OR coalesce(sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id, stretch ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS fresh FROM stretched WHERE type IS NOT NULL
), numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, stretch ORDER BY place) AS entity FROM judged)
SELECT doc_id, type, min(s) AS start, max(e) AS "end", count(*) AS n_tokens, round(CAST(list_reduce(list(score ORDER BY place), lambda a, x: CAST((a + x) / 2 AS FLOAT)) AS DOUBLE), 4) AS score
FROM numbered WHERE entity > 0 GROUP BY doc_id, stretch, entity, type""",
    "distinct_values": f"SELECT type, count(DISTINCT value) AS n_values, true AS close FROM ({_VALUES}) GROUP BY type",
    "top_values": f"SELECT sha256(value) AS value_sha256, n FROM (SELECT value, count(*) AS n FROM ({_VALUES}) GROUP BY value ORDER BY n DESC, value LIMIT 20)",
}
