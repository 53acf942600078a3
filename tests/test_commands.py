"""Commands, settings and the chat client."""

import argparse
import http.server
import json
import threading

import pytest

from palimpsest.__main__ import run
from palimpsest.functions.entities import Switches
from palimpsest.sources.chat_client import CallError, ChatClient, reply_text
from palimpsest.sources.settings import _plain_yaml, load_settings, options_of, temperature

TEXT = "write to a@b.cd or +1 415-555-2671"
MASKED = "write to __PII_EMAIL_ADDRESS_1__ or __PII_PHONE_NUMBER_2__"


def args(**given):
    return argparse.Namespace(**({"config": None, "models_dir": None, "language": None, "json": False, "api_key_file": None, "model": None, "temperature": None} | given))


def test_mask_and_restore(spark):
    assert run(spark, "mask", TEXT, args()) == (MASKED, True)
    whole = json.loads(run(spark, "mask", TEXT, args(json=True))[0])
    assert whole["text"] == MASKED
    assert run(spark, "restore", json.dumps(whole), args()) == (TEXT, True)
    assert [s["text"] for s in json.loads(run(spark, "spans", TEXT, args())[0])] == ["a@b.cd", "+1 415-555-2671"]
    assert run(spark, "roundtrip", TEXT, args())[1]
    assert not run(spark, "roundtrip", "__PII_EMAIL_ADDRESS_1__ a@b.cd", args())[1]


def test_batches(spark):
    out = json.loads(run(spark, "mask-batch", json.dumps([{"text": TEXT}, {"text": "", "language": "en"}]), args())[0])
    assert [x["text"] for x in out] == [MASKED, ""]
    back = json.loads(run(spark, "restore-batch", json.dumps([*out, {"text": "as it is"}]), args())[0])
    assert back == [{"text": TEXT}, {"text": ""}, {"text": "as it is"}]


def test_settings(spark, tmp_path, monkeypatch):
    path = tmp_path / "s.yaml"
    path.write_text('# comment\nport: 8844\naddress_fallback: false\ntemperature: "0.5"\nmask_config:\n  maskEmail: false  # off\n  maskAddress: true\n')
    read = _plain_yaml(path.read_text())
    assert read == {"port": "8844", "address_fallback": False, "temperature": "0.5", "mask_config": {"maskEmail": False, "maskAddress": True}}
    options = options_of(load_settings(str(path)))
    assert options.switches == Switches.all().disable("EMAIL_ADDRESS") and not options.fallback and options.plain()
    assert run(spark, "mask", TEXT, args(config=str(path))) == ("write to a@b.cd or __PII_PHONE_NUMBER_1__", True)
    assert temperature(None, read) == 0.5 and temperature("1", read) == 1.0
    monkeypatch.setenv("PALIMPSEST_TEMPERATURE", "nan")
    with pytest.raises(ValueError):
        temperature(None, read)
    with pytest.raises(FileNotFoundError):
        load_settings(str(tmp_path / "none.yaml"))


class Echo(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        fault = asked["model"] == "bad"
        self.send_response(500 if fault else 200)
        self.end_headers()
        said = f"{asked['model']} {self.headers['Authorization']}: {asked['messages'][0]['content']}"
        self.wfile.write(json.dumps({"choices": [{"message": {"content": said}}]}).encode())

    def log_message(self, *_):
        pass


def test_calls(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1/"
        (tmp_path / "key.json").write_text(json.dumps({"openai-api-key": "k", "openai-base-url": url, "openai-model": "m"}))
        assert run(spark, "call", TEXT, args(api_key_file=str(tmp_path / "key.json"))) == (f"m Bearer k: {TEXT}", True)
        timed = json.loads(run(spark, "call", TEXT, args(api_key_file=str(tmp_path / "key.json"), json=True))[0])
        assert timed["text"] == f"m Bearer k: {TEXT}" and timed["total_ms"] >= timed["mask_ms"] + timed["llm_ms"] and timed["restore_ms"] > 0
        with pytest.raises(CallError, match="500"):
            ChatClient(url, "k")("bad", "x", 0.0)
    finally:
        server.shutdown()
    with pytest.raises(CallError):
        ChatClient("http://127.0.0.1:9", "k")("", "x", 0.0)
    for data in (b"", b"{}", b'{"choices": []}', b'{"error": {"message": "no"}}'):
        with pytest.raises(CallError):
            reply_text(data)
