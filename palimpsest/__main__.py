"""python -m palimpsest COMMAND: mask, spans, restore, roundtrip, mask-batch, restore-batch, call. Reads a file or standard input."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.calls import call_in_stages
from palimpsest.operators.credentials import decode_credential, encode_binary
from palimpsest.operators.masking import mask_frame, restored, roundtrip_frame, span_frame
from palimpsest.sources.chat_client import ChatClient
from palimpsest.sources.settings import load_settings, options_of, temperature
from palimpsest.sources.texts import parse_key_file, setting

COMMANDS = ("mask", "spans", "restore", "roundtrip", "mask-batch", "restore-batch", "call")


def run(spark: SparkSession, command: str, text: str, args: argparse.Namespace) -> tuple[str, bool]:
    """What the command prints, and whether it went well. Texts of a batch are told apart by their place."""
    file = load_settings(args.config)
    options = options_of(file, args.models_dir)
    if command in ("restore", "mask-batch", "restore-batch"):
        items = json.loads(text)
        items = [items] if command == "restore" else items
        rows = [(i, x.get("text") or "", x.get("language") or args.language or "", x.get("maskMeta") or "") for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, "item long, text string, language string, credential string")
        if command == "mask-batch":
            out = mask_frame(df, options=options, language_col="language").select("item", "masked", encode_binary(F.col("meta")).alias("credential"))
            return json.dumps([{"text": r.masked, "maskMeta": r.credential} for r in out.orderBy("item").collect()], ensure_ascii=False), True
        out = df.select("item", "text", decode_credential(F.col("credential")).alias("meta")).select("item", restored(F.col("text"), F.col("meta.original"), F.col("meta.items")).alias("text"))
        texts = [r.text for r in out.orderBy("item").collect()]
        return (texts[0] if command == "restore" else json.dumps([{"text": t} for t in texts], ensure_ascii=False)), True
    df = spark.createDataFrame([(text, args.language or "")], "text string, language string")
    if command == "spans":
        rows = span_frame(df, [], options=options, language_col="language").collect()
        return json.dumps([{"id": r.id, "type": r.type, "text": r.span_text, "start": r.start, "end": r.end, "score": round(r.score, 6)} for r in rows], ensure_ascii=False, indent=2), True
    if command == "mask":
        row = mask_frame(df, options=options, language_col="language").select("masked", encode_binary(F.col("meta")).alias("credential")).first()
        return (json.dumps({"text": row.masked, "maskMeta": row.credential}, ensure_ascii=False) if args.json else row.masked), True
    if command == "roundtrip":
        row = roundtrip_frame(df, options=options).first()
        return f"--- masked ---\n{row.masked}\n--- restored ---\n{row.restored}\n", row.same
    held = parse_key_file(Path(setting("api_key_file", args.api_key_file, file)).expanduser().read_bytes())
    client = ChatClient(held["base_url"], held["api_key"], held["model"])
    with tempfile.TemporaryDirectory() as folder:  # one text: stages are timed one by one
        out, spent = call_in_stages(df.withColumn("item", F.lit(0)), "item", folder, client, args.model or "", temperature(args.temperature, file), options=options, language_col="language")
        text = out.first().restored
    return (json.dumps({"text": text, **{k: round(v, 3) for k, v in spent.items()}}, ensure_ascii=False) if args.json else text), True


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("palimpsest", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("-f", "--file", help="input; standard input if not given")
    parser.add_argument("--json", action="store_true", help="with the credential")
    for name in ("config", "models-dir", "language", "api-key-file", "model", "temperature"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args(argv)
    text = Path(args.file).read_text(encoding="utf-8") if args.file else sys.stdin.read()
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out, good = run(spark, args.command, text, args)
    sys.stdout.write(out)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
