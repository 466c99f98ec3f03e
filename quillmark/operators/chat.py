"""A chat client over HTTP, and its settings from a mapping such as the environment. Neither an address nor a key is
built in; a client that isn't enabled asks nothing."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from quillmark.operators.shadow import CHARS, ITEMS, MOST_CHARS, MOST_ITEMS

#: Seconds that an answer may take, and tokens that it may have.
TIMEOUT, MAX_TOKENS = 30, 512
#: What turns an option on.
YES = ("1", "true", "yes", "y", "on")


@dataclass(frozen=True)
class Settings:
    enabled: bool
    provider: str
    base_url: str
    model: str
    api_key: str
    timeout: int = TIMEOUT
    max_tokens: int = MAX_TOKENS
    evidence_items: int = ITEMS
    evidence_chars: int = CHARS
    selective: bool = False
    run_on_pass: bool = False


def positive(text: str | None, default: int, most: int | None = None) -> int:
    """A whole number above zero, at most most; anything else is the default."""
    try:
        value = int((text or "").strip())
    except ValueError:
        return default
    return default if value <= 0 else value if most is None else min(value, most)


def settings_from(given: Mapping[str, str], prefix: str = "TENDER_LLM_", provider: str = "", model: str = "") -> Settings:
    """Settings of the names prefix + ENABLED, PROVIDER, BASE_URL, MODEL, API_KEY, TIMEOUT_SECONDS, MAX_TOKENS,
    MAX_EVIDENCE_ITEMS, MAX_EVIDENCE_CHARS, SELECTIVE_ENABLED and RUN_ON_PASS; blank ones count as absent."""
    told = {k.removeprefix(prefix): v.strip() for k, v in given.items() if k.startswith(prefix) and v.strip()}
    on = lambda k, words=("true",): told.get(k, "").lower() in words
    return Settings(
        on("ENABLED"), told.get("PROVIDER", provider), told.get("BASE_URL", ""), told.get("MODEL", model), told.get("API_KEY", ""), positive(told.get("TIMEOUT_SECONDS"), TIMEOUT),
        positive(told.get("MAX_TOKENS"), MAX_TOKENS), positive(told.get("MAX_EVIDENCE_ITEMS"), ITEMS, MOST_ITEMS), positive(told.get("MAX_EVIDENCE_CHARS"), CHARS, MOST_CHARS), on("SELECTIVE_ENABLED", YES), on("RUN_ON_PASS", YES),
    )


class HttpClient:
    """Asks a chat completions endpoint; whatever goes wrong is an answer of None with its type and message."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def request(self, prompt: str) -> urllib.request.Request:
        s = self.settings
        body = {"model": s.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": s.max_tokens, "stream": False}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {s.api_key}"}
        return urllib.request.Request(s.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers, method="POST")

    def chat(self, prompt: str) -> tuple[str | None, str | None, str | None]:
        if not self.settings.enabled:
            return None, "disabled", "the client is not enabled"
        try:
            with urllib.request.urlopen(self.request(prompt), timeout=self.settings.timeout) as response:
                raw = response.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return None, "http_error", f"HTTP {e.code}: {e.reason}"
        except urllib.error.URLError as e:
            return None, "url_error", str(e.reason)
        except TimeoutError as e:
            return None, "timeout", str(e)
        except OSError as e:
            return None, type(e).__name__, str(e)
        try:
            answer = json.loads(raw)["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError, ValueError) as e:
            return None, "invalid_response", str(e)
        return (answer, None, None) if isinstance(answer, str) else (None, "invalid_response", "Response content must be a string.")
