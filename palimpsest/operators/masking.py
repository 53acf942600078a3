"""Masking, restoring and the credential between them, as expressions and DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.entities import ENTITIES, Switches
from palimpsest.functions.language import is_chinese, language_or_detected
from palimpsest.functions.rules import RULES, Rule, native
from palimpsest.functions.spans import between, bind, candidates, no_spans, normalized, running_sum, sanitized, slice_bytes, slice_of
from palimpsest.sources.texts import guarded

ITEM = "struct<id:bigint,type_id:tinyint,type:string,start:int,end:int,score:float>"
META = f"struct<original:string,items:array<{ITEM}>>"


@dataclass(frozen=True)
class Options:
    """What a masking plan depends on.

    validators: by a rule's name, functions (matched text, score) -> score; they may change a score, and drop nothing else.
    recognizers: further columns of spans, functions of (text, language); they come after the rules.
    addresses: fuse addresses of Chinese texts; fallback: keep private addresses that fusion makes nothing of.
    """

    rules: tuple[Rule, ...] = RULES
    switches: Switches = field(default_factory=Switches)
    min_score: float = 0.5
    validators: dict[str, Callable[[str, float], float]] = field(default_factory=dict)
    recognizers: tuple[Callable[[Column, Column], Column], ...] = ()
    addresses: bool = False
    fallback: bool = True

    def plain(self) -> bool:
        """Whether rules that Spark runs itself are all there is."""
        return not self.recognizers and not self.addresses and not self.scanned()

    def scanned(self) -> list[Rule]:
        """Rules that need a scan in Python."""
        return [r for r in self.rules if r.name in self.validators or not native(r)]


def type_name(type_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ENTITIES]), type_id.cast("int"))


def placeholder(kind: Column, serial: Column) -> Column:
    return F.concat(F.lit("__PII_"), kind, F.lit("_"), serial.cast("string"), F.lit("__"))


def detected(text: Column, options: Options | None = None, found: Column | None = None) -> Column:
    """Disjoint spans of a text by start, before switches. found: candidates, if the rules' own are not all."""
    options = options or Options()
    if found is None:
        if not options.plain():
            raise ValueError("these options need a DataFrame operator: mask_frame and the like")
        found = candidates(text, options.rules, options.min_score)
    return normalized(sanitized(found, text), options.min_score)


def with_candidates(df: DataFrame, name: str, text_col: str, options: Options, language_col: str | None = None) -> DataFrame:
    """df with the spans of all recognizers, after fusion. Only what is no built-in function runs in Python."""
    text = F.col(text_col)
    slow = options.scanned()
    found = candidates(text, tuple(r for r in options.rules if r not in slow), options.min_score)
    if slow:
        from palimpsest.operators.scanning import scan_rules

        found = F.concat(found, scan_rules(slow, options.validators)(text))
    if not options.recognizers and not options.addresses:
        return df.withColumn(name, found)
    spoken = fresh(df, f"{name}_language")
    df = df.withColumn(spoken, language_or_detected(F.col(language_col) if language_col else None, text))
    for recognizer in options.recognizers:
        found = F.concat(found, F.coalesce(recognizer(text, F.col(spoken)), no_spans()))
    df = df.withColumn(name, found)
    if options.addresses:
        from palimpsest.operators.fusion import with_addresses, with_fused

        made, chinese = fresh(df, f"{name}_fused"), fresh(df, f"{name}_chinese")
        df = with_fused(df.withColumn(chinese, is_chinese(F.col(spoken))), made, text_col, name, chinese)
        df = df.withColumn(name, F.when(F.col(chinese), with_addresses(F.col(name), F.col(made), options.fallback)).otherwise(F.col(name))).drop(made, chinese)
    return df.drop(spoken)


def masked(text: Column, options: Options | None = None, found: Column | None = None) -> Column:
    """struct(masked, items) of a text. Switched-off kinds win their spans, stay as they are and get no number.

    A null text gives a null masked text and no items.
    """
    options = options or Options()
    spans = F.filter(F.coalesce(detected(text, options, found), no_spans()), lambda s: is_enabled(s["type_id"], options.switches))
    return bind(spans, lambda s: rewritten(text, s))


def is_enabled(type_id: Column, switches: Switches) -> Column:
    return F.element_at(F.array(*[F.lit(switches.enabled(k)) for k in ENTITIES]), type_id.cast("int"))


def rewritten(text: Column, spans: Column) -> Column:
    """struct(masked, items) of a text and its disjoint spans by start, all of which are masked."""
    items_type = f"array<{ITEM}>"
    serial = lambda i: (i + 1).cast("bigint")
    item = lambda s, i: F.struct(serial(i).alias("id"), s["type_id"].alias("type_id"), type_name(s["type_id"]).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
    done = F.struct(between(text, spans, lambda s, i: placeholder(type_name(s["type_id"]), serial(i))).alias("masked"), F.transform(spans, item).cast(items_type).alias("items"))
    untouched = F.struct(text.alias("masked"), F.array().cast(items_type).alias("items"))
    return F.when(F.size(spans) > 0, done).otherwise(untouched)


def lookup(original: Column, items: Column, serial: Column) -> Column:
    """The text behind a placeholder's number; null if there is none or its place is beyond the original."""
    found = F.filter(items, lambda i: i["id"] == serial)
    return bind(F.get(found, F.lit(0)), lambda i: F.when((i["start"] >= 0) & (i["start"] < i["end"]) & (i["end"] <= F.octet_length(original)), slice_bytes(original, i["start"], i["end"] - i["start"])))


def restored(reply: Column, original: Column, items: Column) -> Column:
    """The reply with the first of each item's placeholders replaced by what it stands for.

    Items whose placeholder is not there or whose place is beyond the original are passed over; unknown placeholders stay.
    """
    # A placeholder without its last two characters, which may be the next one's first two.
    found = rf"(__PII_(?:{'|'.join(ENTITIES)})_[0-9]+)(?=__)"
    valid = F.filter(items, lambda i: (i["start"] >= 0) & (i["start"] < i["end"]) & (i["end"] <= F.octet_length(original)) & i["type_id"].between(1, len(ENTITIES)))
    name = lambda i: F.concat(F.lit("__PII_"), type_name(i["type_id"]), F.lit("_"), i["id"].cast("string"))
    held = bind(original.cast("binary"), lambda data: F.transform(valid, lambda i: F.struct(name(i).alias("name"), F.lit(0).alias("end"), slice_of(data, i["start"], i["end"] - i["start"]).alias("text"))))

    def rebuilt(names: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(reply, found, -1), 1, F.size(names)), names, lambda gap, n: F.octet_length(gap) + F.octet_length(n))
        seen = F.zip_with(running_sum(sizes), names, lambda end, n: F.struct(n.alias("name"), end.alias("end"), F.lit(None).cast("string").alias("text")))
        # An item, then its placeholders by place: the first one comes right behind it.
        slot = lambda x, before: F.when((x["end"] > 0) & (before["end"] == 0) & (before["name"] == x["name"]), F.struct((x["end"] - F.octet_length(x["name"])).alias("start"), (x["end"] + 2).alias("end"), before["text"].alias("text")))
        slots = bind(F.array_sort(F.concat(held, seen)), lambda all_: F.transform(all_, lambda x, i: slot(x, F.get(all_, i - 1))))
        return bind(F.array_sort(F.filter(slots, lambda s: s.isNotNull())), lambda s: between(reply, s, lambda x, i: x["text"]))

    names = F.regexp_extract_all(reply, F.lit(found), F.lit(1))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, bind(names, lambda n: F.when(F.size(n) > 0, rebuilt(n)).otherwise(reply))).otherwise(reply)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a variant that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unclaimed(df: DataFrame, *names: str) -> None:
    """A result never takes the place of a column that is there already."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already: name the results otherwise")


def _masking(df: DataFrame, name: str, text_col: str, options: Options | None, language_col: str | None) -> DataFrame:
    """df with struct(masked, items). A generator of one row keeps the expression whole: the optimizer merges it with no later
    projection, where it might be computed twice or stand in the argument of a Python function."""
    options = options or Options()
    only = lambda made: F.explode_outer(F.array(made)).alias(name)
    if options.plain():
        return df.select("*", only(masked(F.col(text_col), options)))
    spans = fresh(df, "masking_spans")
    df = with_candidates(df, spans, text_col, options, language_col)
    return df.select("*", only(masked(F.col(text_col), options, F.col(spans)))).drop(spans)


def mask_frame(df: DataFrame, text_col: str = "text", options: Options | None = None, language_col: str | None = None, masked_col: str = "masked", meta_col: str = "meta", error_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """df with masked and meta (original, items). One stage, no shuffle; meta holds the original: keep it apart.

    With error_col, rows are an envelope of either results or an error (message, code): a missing text or one of more than
    max_bytes (32 MiB) gets null results and its error. Columns of df keep their values; results under the name of one of them are refused.
    """
    unclaimed(df, masked_col, meta_col, *([error_col] if error_col else []))
    source = text_col
    if error_col:
        source = fresh(df, "masking_source")
        df = guarded(df, text_col, error_col, max_bytes).withColumn(source, F.when(F.col(error_col).isNull(), F.col(text_col)))
    name = fresh(df, "masking")
    out = _masking(df, name, source, options, language_col)
    meta = F.struct(F.col(source).alias("original"), F.col(f"{name}.items").alias("items"))
    out = out.withColumn(masked_col, F.col(f"{name}.masked")).withColumn(meta_col, F.when(F.col(error_col).isNull(), meta) if error_col else meta)
    return out.drop(name, *([source] if error_col else []))


def span_frame(df: DataFrame, keys: list[str], text_col: str = "text", options: Options | None = None, language_col: str | None = None) -> DataFrame:
    """Keys and one row per item: id, type, start, end, score and the text itself."""
    unclaimed(df.select(*keys), "id", "type", "start", "end", "score", "span_text")
    narrow = df.select(*keys, *(c for c in dict.fromkeys((text_col, language_col)) if c and c not in keys))
    name = fresh(narrow, "masking")
    out = _masking(narrow, name, text_col, options, language_col)
    told = lambda data: F.transform(F.col(f"{name}.items"), lambda i: F.struct(i["id"].alias("id"), i["type"].alias("type"), i["start"].alias("start"), i["end"].alias("end"), i["score"].alias("score"), slice_of(data, i["start"], i["end"] - i["start"]).alias("span_text")))
    # Texts of spans are cut out before rows multiply, so that no row carries the whole text. An inner explode would have
    # the optimizer test the items' size first, and so find all spans twice.
    item = fresh(narrow, "item")
    rows = out.select(*keys, F.explode_outer(bind(F.col(text_col).cast("binary"), told)).alias(item)).where(F.col(item).isNotNull())
    return rows.select(*keys, f"{item}.*")


def restore_frame(replies: DataFrame, metas: DataFrame, key: str, reply_col: str = "reply", meta_col: str = "meta", restored_col: str = "restored") -> DataFrame:
    """replies with restored; one without meta stays as it is. Other columns of metas are left out."""
    unclaimed(replies, restored_col)
    held = fresh(replies, "held_meta")
    joined = replies.join(metas.select(key, F.col(meta_col).alias(held)), key, "left")
    return joined.withColumn(restored_col, restored(F.col(reply_col), F.col(f"{held}.original"), F.col(f"{held}.items"))).drop(held)


def roundtrip_frame(df: DataFrame, text_col: str = "text", options: Options | None = None) -> DataFrame:
    """df with masked, restored, n_items and whether the restored text is the original."""
    unclaimed(df, "masked", "restored", "n_items", "same")
    meta = fresh(df, "meta")
    out = mask_frame(df, text_col, options, meta_col=meta)
    out = out.withColumn("restored", restored(F.col("masked"), F.col(f"{meta}.original"), F.col(f"{meta}.items")))
    return out.withColumn("n_items", F.size(f"{meta}.items")).withColumn("same", F.col("restored").eqNullSafe(F.col(text_col))).drop(meta)
