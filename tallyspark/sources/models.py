"""Models by HTTP, as functions for the text pipeline.  Each is picklable, so it goes to workers as it is."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from functools import lru_cache

from tallyspark.functions.replies import Reply


def without_think(text: str) -> str:
    return re.sub(r"<think>.*?</think>", "", text, flags=re.S | re.I).strip()


def base_url(host: str | None, default: str = "127.0.0.1:11434") -> str:
    """A URL of a host that may lack scheme and port."""
    host = (host or default).strip().rstrip("/")
    host = host if "//" in host else f"http://{host}"
    return host if re.search(r":\d+$", host) or host.startswith("https") else f"{host}:11434"


@dataclass(frozen=True)
class Served:
    """A model behind a generate endpoint that takes and gives JSON; server errors are tried again, all others are told."""

    model: str
    host: str | None = None
    temperature: float = 0.0
    context: int = 8192
    timeout: int = 900
    retries: int = 1
    json_mode: bool = True

    def __post_init__(self):
        if not 0 <= self.temperature <= 2:
            raise ValueError("a temperature is between 0 and 2")

    def __call__(self, prompt: str, limit: int) -> Reply:
        ask = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_ctx": self.context, "num_predict": limit}}
        body = json.dumps(ask | ({"format": "json"} if self.json_mode else {})).encode()
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(f"{base_url(self.host)}/api/generate", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as f:  # noqa: S310
                    out = json.load(f)
                return Reply(without_think(out.get("response", "")), truncated=out.get("done_reason") == "length")
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == self.retries:
                    return Reply("", f"HTTP {e.code}")
                time.sleep(min(2.0, 0.5 * (attempt + 1)))
            except (OSError, ValueError) as e:
                return Reply("", f"{type(e).__name__}: {e}")
        return Reply("", "no answer")


def served_models(host: str | None = None, timeout: int = 10) -> list[str]:
    """Names of the models that a server has."""
    with urllib.request.urlopen(f"{base_url(host)}/api/tags", timeout=timeout) as f:  # noqa: S310
        return sorted(m["name"] for m in json.load(f).get("models", []))


@dataclass(frozen=True)
class Hosted:
    """A model behind a chat-completions endpoint with a key; the key's variable is named, not stored."""

    model: str
    url: str
    key_variable: str = "HF_TOKEN"
    temperature: float = 0.0
    timeout: int = 900

    def __call__(self, prompt: str, limit: int) -> Reply:
        ask = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": limit, "temperature": self.temperature}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(ask).encode(), headers), timeout=self.timeout) as f:  # noqa: S310
                said = json.load(f)["choices"][0]
            return Reply(without_think(said["message"]["content"] or ""), truncated=said.get("finish_reason") == "length")
        except (OSError, ValueError, LookupError) as e:
            return Reply("", f"{type(e).__name__}: {e}")


@dataclass(frozen=True)
class Local:
    """A model that each worker loads once, if the transformers library is there."""

    model: str
    temperature: float = 0.0

    def __call__(self, prompt: str, limit: int) -> Reply:
        try:
            said = _pipeline(self.model)(prompt, max_new_tokens=limit, do_sample=self.temperature > 0, **({"temperature": self.temperature} if self.temperature else {}), return_full_text=False)
        except (ImportError, OSError, ValueError) as e:
            return Reply("", f"{type(e).__name__}: {e}")
        return Reply(without_think(said[0]["generated_text"]))


@lru_cache
def _pipeline(model: str):
    from transformers import pipeline  # not part of every installation

    return pipeline("text-generation", model=model)


PROVIDERS = {"served": Served, "hosted": Hosted, "local": Local}


def provider(kind: str, model: str, **options):
    """A model of one of the kinds in `PROVIDERS`."""
    if kind not in PROVIDERS:
        raise ValueError(f"{kind}: known are {', '.join(PROVIDERS)}")
    if not 0 <= options.get("temperature", 0) <= 2:
        raise ValueError("a temperature is between 0 and 2")
    return PROVIDERS[kind](model, **options)
