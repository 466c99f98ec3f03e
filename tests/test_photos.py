import urllib.error

import pytest

from quillmark.operators import audit, photos


def test_answers():
    assert photos.parse_answer('draft {"state":"closed"} final {"state": "open", "confidence": 0.9} }') == {"state": "open", "confidence": 0.9}
    assert photos.parse_answer('```json\n{"pack_open": "yes"}\n```') == {"pack_open": "yes"}
    assert photos.parse_answer('{"state":"open","confidence":0.5') == {"state": "open", "confidence": 0.5}
    assert photos.parse_answer('{"state":"open","evidence":["a') == {"state": "open"}
    assert photos.parse_answer('x "foil_removed": null') == {"pack_open": None}
    assert photos.parse_answer("nothing") is None and photos.parse_answer(None) is None


def test_results():
    got = photos.foil_result({"state": "Open", "confidence": 7, "evidence": ["a", "b"], "lid_raised": True})
    assert got == {"foil_removed": True, "confidence": 1.0, "reason": "a; b [крышка приподнята]", "review_needed": False, "error": None}
    assert photos.foil_result({"state": "undetermined", "confidence": "x"})["review_needed"]
    assert photos.foil_result({"foil_removed": "closed", "confidence": 0.8})["foil_removed"] is False
    assert photos.foil_result([])["error"] == photos.foil_result({"a": 1})["error"] == "bad_schema"


def test_retries(tmp_path):
    calls = []

    def fails(code):
        def call():
            calls.append(code)
            raise urllib.error.HTTPError("u", code, "m", {}, None)

        return call

    for code, n in ((404, 1), (503, 2)):
        calls.clear()
        with pytest.raises(urllib.error.HTTPError):
            photos.retried(fails(code), wait=0)
        assert len(calls) == n
    asked = []
    get = photos.cached(lambda u: asked.append(u) or b"x", str(tmp_path))
    assert get("a") == get("a") == b"x" and asked == ["a"]
    assert photos.first_decoded(1, iter([("2x", 2)]), [("e", lambda p: "c" if p == 2 else None)]) == ("c", "e:2x", 2)


def test_hint_after_a_bad_answer():
    hints = []
    ask = lambda data, hint: hints.append(hint) or ("nonsense" if not hint else '{"state":"open","confidence":1}')
    assert photos.check_foil(b"", ask)["foil_removed"] is True and hints == ["", photos.STRICTER]


def test_rows_to_flags(spark):
    def clients():
        fetched = []

        def fetch(url):
            fetched.append(url)
            if url == "down":
                raise OSError("no route")
            assert fetched.count("pack4") <= 1
            return url.encode()

        def decode(data):
            if data == b"crash":
                raise RuntimeError("engine")
            return ("00000046a", None) if data in (b"good", b"pack2") else (None, "no_barcode_found")

        def ask(data, hint):
            return '{"state":"open","confidence":0.9}'

        return photos.Clients(fetch, decode, ask)

    rows = [(1, "00000046a", "good", "pack1"), (2, "00000046a", "bad", "pack2"), (3, "x", "down", "down"), (4, "x", None, "pack4"), (5, "00000046b", "good", None), (6, "x", "bad", "crash")]
    facts = photos.process(spark.createDataFrame(rows, "row int, dmc_ref string, photo_dmc string, photo_pack string"), clients)
    got = {r["row"]: r for r in facts.collect()}
    assert [got[i]["decode_source"] for i in range(1, 7)] == ["AG", "AF", None, None, "AG", None]
    assert got[3]["decode_error"] == "AG:download_error: no route; AF_download:no route" and got[4]["decode_error"] == "AG:empty_url; AF:no_barcode_found"
    assert got[6]["decode_error"] == "RuntimeError: engine" and not got[6]["foil_checked"]
    flags = {r["row"]: (r["ai"], r["aj"], r["ak"], r["an"]) for r in audit.evaluate(facts).collect()}
    assert flags[1] == ("", "", "", "1") and flags[5] == ("1", "", "1", "0") and flags[3] == ("1", "1", "", "0")


def test_rows_in_a_window(spark):
    import threading
    import time

    most, now, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return x

    assert list(photos.in_window(iter(range(40)), call, 4)) == list(range(40)) and most[0] == 4
    assert list(photos.in_window(iter(range(40)), call, 4, until=0.0)) == []
    drawn = []
    window = photos.in_window((drawn.append(i) or i for i in range(100)), call, 3)
    assert next(window) == 0 and len(drawn) == 6
    window.close()
    rows = spark.createDataFrame([(i, "r", None, None) for i in range(300)], "row int, dmc_ref string, photo_dmc string, photo_pack string").repartition(2)
    clients = lambda: photos.Clients(lambda url: b"", lambda data: (None, None))
    assert sorted(r["row"] for r in photos.process(rows, clients, workers=5).collect()) == list(range(300))
    assert photos.process(rows, clients, seconds=-1).count() == 0
