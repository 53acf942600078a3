"""A client for services that speak the common chat-completion protocol. It can be pickled; each call opens its own connection."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass

#: Seconds to wait, bytes of a reply. Fixed values.
TIMEOUT, MAX_REPLY = 120, 8 << 20


class CallError(RuntimeError):
    """The service refused, or its reply can't be used."""


@dataclass(frozen=True)
class ChatClient:
    base_url: str
    key: str
    model: str = ""

    def request(self, model: str, prompt: str, temperature: float) -> urllib.request.Request:
        name = model or self.model
        if not name:
            raise CallError("no model is named")
        body = {"model": name, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        return urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)

    def __call__(self, model: str, prompt: str, temperature: float) -> str:
        try:
            with urllib.request.urlopen(self.request(model, prompt, temperature), timeout=TIMEOUT) as reply:
                data = reply.read(MAX_REPLY + 1)
        except urllib.error.HTTPError as error:
            raise CallError(f"the service answered {error.code}") from error
        except OSError as error:
            raise CallError("the service can't be reached") from error
        if len(data) > MAX_REPLY:
            raise CallError("the reply is too long")
        return reply_text(data)


def reply_text(data: bytes) -> str:
    try:
        body = json.loads(data)
        if body.get("error"):
            raise CallError(str(body["error"].get("message") or "the service reports an error"))
        return body["choices"][0]["message"]["content"] or ""
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as error:
        raise CallError("the reply has no text") from error
