import json

import pytest

from sentiero.llm.truncation import end_of, truncated, truncation_report

WORDS = "la serie oraria ordina le distanze in metri prima della pulizia e la mappa mostra i punti isolati".split()


def _text(i: int, n: int) -> str:
    out = []
    for k in range(n):
        out.append(" ".join(WORDS[(i + k + j) % len(WORDS)] for j in range(9)) + ".")
    return "\n".join(out) + "\n\nGrazie per la lettura" + ("\n" if i % 2 else "")


@pytest.mark.parametrize(
    ("text", "verdict"),
    [("Fine.", "whole"), ("", "whole"), ("a\n", "whole"), (json.dumps({"cells": []}), "whole"), ('{"cells": [{"a": "b', "cut"), ("```python\nx = 1", "cut"), ("```python\nx = 1\n```", "whole"), ("for k in range(", "cut"), ("1   2.000   3.000\n2   2.0", "cut"), ("tutto prim", "ask"), ("{not json} text.", "whole")],
)
def test_ends(text, verdict):
    assert end_of(text)[0] == verdict


def test_long_last_tokens_are_whole():
    from sentiero.llm.truncation import _tail

    a, b = "x" * 100 + "one", "y" * 100 + "one"
    assert _tail(f"the {a}") != _tail(f"the {b}") and _tail(f"the {a}") == f"the {a}"
    assert _tail("una riga " * 30 + "di testo") == "di testo"


def test_limits_and_losses(spark):
    rows = [(i, _text(i, 3 + i % 17), "free") for i in range(300)]
    rows += [(1000 + i, _text(i, 3 + i % 17)[:900], "chars") for i in range(300)]
    rows += [(2000 + i, _text(i, 3 + i % 17).replace("mostra", "mòstra").encode()[:900].decode(errors="ignore"), "bytes") for i in range(300)]
    lost = [(3000 + i, _text(i, 10)[: 200 + 31 * i].rstrip(" ."), "free") for i in range(10)]
    lost = [(i, t if not t.endswith(("pulizia", "isolati", "lettura")) else t[:-2], s) for i, t, s in lost]
    df = spark.createDataFrame([*rows, *lost, rows[0], (None, "x", "free"), (4000, None, "free"), (4001, "", None)], "doc bigint, body string, src string")
    flags = {r["id"]: r for r in truncated(df, "doc", "body", "src").collect()}
    assert set(flags) == {i for i, _, _ in rows + lost} | {4001}
    natural = {i for i, t, s in rows if s == "free" or len(t.encode()) < 897}
    assert not [i for i in natural if flags[i]["truncated"]]
    assert all(flags[i]["truncated"] for i, _, _ in lost)
    at = [i for i, t, s in rows if s != "free" and len(t.encode()) >= 900 and t[-1] not in ".\n"]
    assert len(at) > 20 and sum(flags[i]["truncated"] for i in at) >= 0.97 * len(at)
    report = {r["source"]: r for r in truncation_report(truncated(df, "doc", "body", "src")).collect()}
    assert report["free"]["truncated_texts"] == 10 and report["free"]["unterminated"] == 0
    plain = {i for i, t, s in rows if s == "chars" and len(t) == 900 and t[-1] not in ".!?;"}
    assert plain == {i for i in flags if 1000 <= i < 2000 and flags[i]["unterminated"]} and report["chars"]["unterminated"] == len(plain)
    assert truncated(df.limit(0), "doc", "body", "src").count() == 0
