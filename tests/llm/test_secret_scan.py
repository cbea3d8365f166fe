import random
import re

import brute
import numpy as np
import pytest

from rolegrid.llm import secret_scan as s

BASE = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def texts():
    rng = random.Random(1)
    parts = ["password=", "Token = '", "api_key:", "APIKEY  :  \"", "secret", "tokén=", "Key=", "=", ":", " ", "é",
             "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeefcafe", "x.y_z/12-+=", "\n", "passwd\" :", "AKIAAKIA"]
    return ["", "no keys here"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600)]


def test_base_findings_match_the_plain_patterns():
    for text in texts():
        got = [(s.KINDS[k], a, b) for a, k, b in s.base_findings(text)]
        assert got == base(text), repr(text)


def test_network_on_held_out_findings():
    rows = s.labelled_findings(1200, 99)
    net = s.trained()
    p = net.probabilities(np.array([s.encode_views(t, a, b)[0] for t, a, b, _ in rows]))
    y = np.array([r[3] for r in rows])
    assert (p[y == 1] >= net.threshold).mean() >= s.RECALL - 0.02
    assert (p[y == 0] >= net.threshold).mean() <= 0.05
    assert abs(p.mean() - y.mean()) < 0.05  # calibrated


def test_scan_adds_spans_and_keeps_base(spark):
    key = "ghp_" + "a8Kd02LmQz7RtYw41PoXcVbN9s" * 4
    docs = [brute.doc(i, t) for i, t in enumerate(texts()[:80])] + brute.odd_docs() + [
        brute.doc(500, f"bearer {key} end"), brute.doc(501, "see www.example.com/a/b2/page.html and 2024-01-02T10.11.12Z"),
        brute.doc(500, f"bearer {key} end")]
    df = spark.createDataFrame([(*d, "x") for d in docs], brute.DOCS + ", findings string")
    got = s.scan(df).collect()
    assert len(got) == len(docs)
    for r, d in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(docs, key=lambda d: repr(d[0])), strict=True):
        assert [(f.kind, f.start, f.end) for f in r.findings if f.kind != "cnn"] == base(d[1] or "") or r.doc_id == 9004
    found = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in got}
    assert found[500] == [("cnn", 7, 7 + len(key))] and found[501] == []


def test_redaction(spark):
    docs = [brute.doc(1, "a password=abcdef0123456789 b é 0123456789abcdef0 c"), brute.doc(2, "plain"), brute.doc(3, None)]
    out = {r.doc_id: r for r in s.redact(spark.createDataFrame(docs, brute.DOCS)).collect()}
    assert out[1].text == f"a {s.MASK} b é {s.MASK} c" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "plain" and out[3].text is None
    empty = spark.createDataFrame([], brute.DOCS)
    assert s.redact(empty).collect() == [] and s.scan(empty).collect() == []


@pytest.mark.parametrize("size", [16, 48, 49, 200])
def test_long_candidates_are_read_whole(size):
    views = s.encode_views("x" * 30 + "K" * size + "y" * 5, 30, 30 + size)
    seen = sum(((v - s._CHARS) == ord("K") - 31).sum() for v in views)
    assert seen >= size


def test_runs_beyond_a_base_finding_and_of_one_kind_are_candidates():
    key = "xkeysib-" + "0a1b2c3d" * 8 + "-" + "aB3dE5gH7jK9mN1p"
    text = f"send {key} now"
    assert s.extra_candidates(text, s.base_findings(text)) == [(5, 5 + len(key))]
    assert s.redacted(text, s.findings([text], s.trained())[0]) == f"send {s.MASK} now"
    for run in ("QwZrTpLkXvBnMsDfGhJc", "90271", "4920185736102948", "aB3dE5gH7j"):
        assert s.extra_candidates(f"x {run} y", []) == ([(2, 2 + len(run))] if len(run) >= s.MIN_RUN else [])
    assert s.findings(["x QwZrTpLkXvBnMsDfGhJc y"], s.trained())[0]
    whole = "password=abcdef0123456789"
    assert s.extra_candidates(whole, s.base_findings(whole)) == []


def test_recall_through_the_candidates_on_keys_as_written():
    rows, net, need, hit = s.labelled_findings(4000, 99), s.trained(), 0, 0
    assert any(not any(c.isdigit() for c in t[a:b]) for t, a, b, label in rows if label)
    for (text, a, b, label), found in zip(rows, s.findings([r[0] for r in rows], net), strict=True):
        base = s.base_findings(text)
        if label and not any(x <= a and b <= y for x, _, y in base):
            need += 1
            hit += any(k == 3 and x <= a and b <= y + len(text[y:b]) - len(text[y:b].lstrip("._-/")) for x, k, y, _ in found)
    assert need > 1000 and hit / need >= s.RECALL - 0.02
