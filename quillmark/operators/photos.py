"""Photo checks of audit rows: fetching, decoding and a vision model's answer, through clients that the caller gives.

A row's second photo is fetched at most once, for the fallback decode and for the foil check. Whatever goes wrong
becomes a value in the row: a broken client never ends the run.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
import urllib.error
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.functions import fixed

#: Answers that mean yes and no, characters of a reason, and what makes a model keep to the format.
YES, NO, REASON_CHARS = ("true", "yes", "open", "1"), ("false", "no", "closed", "0"), 300
SEEN_ENDS, LID_UP = "торцы видны", "крышка приподнята"
STRICTER = "\n\nВАЖНО: верни СТРОГО один JSON-объект указанного формата и ничего больше — без пояснений и без повтора этих инструкций."

FACTS = (
    "row int, dmc_ref string, decoded string, decode_source string, decode_error string, code_matches boolean, af_present boolean, foil_removed boolean, foil_checked boolean,"
    " foil_confidence double, foil_reason string, foil_review_needed boolean, foil_error string"
)
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema({n: _KINDS[t] for n, t in (x.split() for x in FACTS.split(","))})


# --- answers of a vision model ---
def json_objects(text: str) -> list[str]:
    """The complete outermost {...} parts of a text, in order."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : m.end()])
    return out


def _salvaged(text: str) -> dict | None:
    """Fields of an answer that doesn't parse, the last of each."""
    last = lambda pattern: (re.findall(pattern, text, re.IGNORECASE) or [None])[-1]
    out: dict = {}
    if state := last(r'"state"\s*:\s*"(open|closed|undetermined)"'):
        out["state"] = state.lower()
    elif told := last(r'"(?:pack_open|foil_removed)"\s*:\s*(true|false|null)'):
        out["pack_open"] = {"true": True, "false": False}.get(told.lower())
    else:
        return None
    if number := last(r'"confidence"\s*:\s*(\d*\.?\d+)'):
        out["confidence"] = float(number)
    for name in ("visible_cigarette_ends", "lid_raised"):
        if told := last(rf'"{name}"\s*:\s*(true|false)'):
            out[name] = told.lower() == "true"
    return out


def parse_answer(text: str | None) -> dict | None:
    """The last object of an answer that is JSON; else one that lacks its end; else single fields."""
    body = re.sub(r"^json\s*", "", (text or "").strip().strip("`"), flags=re.IGNORECASE)
    for part in reversed(json_objects(body)):
        try:
            return json.loads(part)
        except ValueError:
            continue
    if "{" in body and "}" not in body[body.index("{") :]:
        try:
            return json.loads(body[body.index("{") :] + "}")
        except ValueError:
            pass
    return _salvaged(body)


def as_bool(value: object) -> bool | None:
    if isinstance(value, bool) or value is None:
        return value
    text = str(value).strip().lower()
    return True if text in YES else False if text in NO else None


def foil_result(answer: object, least_confidence: float = 0.75) -> dict:
    """(foil_removed, confidence, reason, review_needed, error) of a parsed answer; an unknown or unsure one is for review."""
    known = isinstance(answer, dict) and next((k for k in ("state", "pack_open", "foil_removed") if k in answer), None)
    if not known:
        return foil_failure("bad_schema", "model returned off-schema output")
    removed = {"open": True, "closed": False}.get(str(answer[known]).strip().lower()) if known == "state" else as_bool(answer[known])
    try:
        confidence = min(1.0, max(0.0, float(answer.get("confidence", 0.0))))
    except (TypeError, ValueError):
        confidence = 0.0
    found = answer.get("evidence")
    reason = "; ".join(map(str, found)) if isinstance(found, list) and found else str(answer.get("reason", ""))
    signs = [label for key, label in (("visible_cigarette_ends", SEEN_ENDS), ("lid_raised", LID_UP)) if answer.get(key) is True]
    if signs:
        reason = f"{reason} [{', '.join(signs)}]".strip()
    return {"foil_removed": removed, "confidence": confidence, "reason": reason[:REASON_CHARS], "review_needed": removed is None or confidence < least_confidence, "error": None}


def foil_failure(error: str, reason: str = "") -> dict:
    return {"foil_removed": None, "confidence": 0.0, "reason": reason, "review_needed": True, "error": error}


#: Rows that a task works on at a time, and facts that it hands over together.
WORKERS, TOGETHER = 12, 200


# --- clients ---
def retried(call: Callable[[], object], tries: int = 2, wait: float = 1.5) -> object:
    """call's value; errors of the other side are tried again after a growing wait, refusals (4xx) are not."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception as e:
            refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500
            if refused or n == tries:
                raise
            time.sleep(wait * n)
    raise ValueError("tries must be at least 1")


def cached(fetch: Callable[[str], bytes], folder: str) -> Callable[[str], bytes]:
    """fetch with a folder of earlier results, named by a hash of the address; a file appears whole or not at all."""

    def get(url: str) -> bytes:
        path = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest())
        if os.path.exists(path):
            with open(path, "rb") as f:
                return f.read()
        data = fetch(url)
        os.makedirs(folder, exist_ok=True)
        draft = f"{path}.{os.getpid()}"
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, path)
        return data

    return get


def first_decoded(image: object, variants: Iterator[tuple[str, object]], engines: list[tuple[str, Callable[[object], str | None]]]) -> tuple[str | None, str | None, int]:
    """(code, engine and variant, attempts): engines on an image and then on its variants, until one reads it."""
    attempts = 0
    for name, picture in [("raw", image), *variants]:
        for engine, read in engines:
            attempts += 1
            if code := read(picture):
                return code, f"{engine}:{name}", attempts
    return None, None, attempts


@dataclass(frozen=True)
class Clients:
    """What a task calls: an address to bytes, bytes to (code or None, error), bytes and a hint to a model's text."""

    fetch: Callable[[str], bytes]
    decode: Callable[[bytes], tuple[str | None, str | None]]
    ask: Callable[[bytes, str], str] | None = None


def check_foil(data: bytes, ask: Callable[[bytes, str], str], least_confidence: float = 0.75) -> dict:
    """The model's verdict; an answer off the format is asked for once more, with a stricter hint."""
    result = foil_failure("bad_schema")
    for hint in ("", STRICTER):
        try:
            text = ask(data, hint)
        except Exception as e:
            return foil_failure(f"litellm_error: {e}")
        result = foil_result(parse_answer(text), least_confidence)
        if result["error"] != "bad_schema":
            break
    return result


def normalize_code_text(code: str | None, ignore_case: bool = False) -> str:
    out = re.sub(r"\A\][A-Za-z]\d", "", code or "").translate(dict.fromkeys(map(ord, fixed.GS_CONTROLS)))
    for mark in fixed.GS_TEXTS:
        out = out.replace(mark, "")
    out = "".join(out.split())
    return out.upper() if ignore_case else out


def process_row(record: dict, clients: Clients, ignore_case: bool = False) -> dict:
    """Facts of one row (row, dmc_ref, photo_dmc, photo_pack). The foil is checked where the clients have a model."""
    pack, held = record.get("photo_pack"), {}

    def second() -> bytes | None:
        if not held and pack:
            try:
                held["data"] = clients.fetch(pack)
            except Exception as e:
                held["error"] = str(e)
        return held.get("data")

    try:
        code, error = clients.decode(clients.fetch(record["photo_dmc"])) if record.get("photo_dmc") else (None, "empty_url")
    except Exception as e:
        code, error = None, f"download_error: {e}"
    source = "AG" if code else None
    if not code and pack:
        first = f"AG:{error or 'no_barcode_found'}"
        if data := second():
            code, other = clients.decode(data)
            source, error = ("AF", error) if code else (None, f"{first}; AF:{other}")
        elif "error" in held:
            error = f"{first}; AF_download:{held['error']}"
    own = normalize_code_text(code, ignore_case)
    out = {"row": record["row"], "dmc_ref": record.get("dmc_ref"), "decoded": code, "decode_source": source, "decode_error": error, "af_present": bool(pack), "foil_checked": False}
    out["code_matches"] = (own != "" and normalize_code_text(record.get("dmc_ref"), ignore_case) == own) if code else None
    if clients.ask is not None:
        if not pack:
            foil = foil_failure("empty_url")
        elif (data := second()) is None:
            foil = foil_failure(f"download_error: {held.get('error')}")
        else:
            foil = check_foil(data, clients.ask)
        out |= {"foil_checked": True, "foil_removed": foil["foil_removed"], "foil_confidence": foil["confidence"], "foil_reason": foil["reason"], "foil_review_needed": foil["review_needed"], "foil_error": foil["error"]}
    return out


def in_window(items: Iterator[object], call: Callable[[object], object], workers: int, until: float | None = None) -> Iterator[object]:
    """call of every item, in order, by so many threads; at most twice as many items are under way. After until (seconds
    of the system's clock) no further item begins; those that have begun still end."""
    with ThreadPoolExecutor(workers) as pool:
        going: deque[Future] = deque()
        for item in items:
            if until is not None and time.time() >= until:
                break
            going.append(pool.submit(call, item))
            if len(going) >= 2 * workers:
                yield going.popleft().result()
        while going:
            yield going.popleft().result()


def process(rows: DataFrame, clients: Callable[[], Clients], ignore_case: bool = False, workers: int = WORKERS, seconds: float | None = None) -> DataFrame:
    """Facts of all rows, so many of a task at a time, since they wait for others most of it; clients makes a thread's
    own. An unexpected error gives a full row that names it. seconds from now no further row begins; those that are left
    have no facts, and a later run finds them by audit.pending. Tasks may run again, so calls should be safe to repeat."""
    until = None if seconds is None else time.time() + seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = threading.local()

        def facts(record: dict) -> dict:
            try:
                if not hasattr(own, "clients"):
                    own.clients = clients()
                return process_row(record, own.clients, ignore_case)
            except Exception as e:
                return {"row": record["row"], "dmc_ref": record.get("dmc_ref"), "af_present": bool(record.get("photo_pack")), "decode_error": f"{type(e).__name__}: {e}", "foil_checked": False}

        found = in_window((r for batch in batches for r in batch.to_pylist()), facts, workers, until)
        while held := list(islice(found, TOGETHER)):
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return rows.select("row", "dmc_ref", "photo_dmc", "photo_pack").mapInArrow(run, FACTS)
