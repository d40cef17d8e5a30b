"""Parts of credentials are joined as intervals, by the gap between them."""

import numpy as np

from placekit.llm.secret_scans import BASE, NEEDS, PART, SCOPE, link_parts, redact, report


def test_a_long_value_does_not_cut_itself_off(spark):
    text = "private_key: " + "Ab1x" * 75 + " client_id = ab12cd34"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = report(d).first().spans.split(",")
    assert "weak_secret:0:313" in spans and "weak_id:314:334" in spans
    assert redact(d).first().text == "[SECRET] [SECRET]"


def test_links_against_all_pairs(spark):
    """Short and long spans at all distances, the bound and one beyond it among them."""
    rng = np.random.default_rng(3)
    spans = [(b"a", "random", 0, 400), (b"a", "weak_id", 400 + SCOPE, 410 + SCOPE), (b"b", "random", 0, 400), (b"b", "weak_id", 401 + SCOPE, 411 + SCOPE)]
    for i in range(60):
        for kind in PART:
            at = 0
            for _ in range(rng.integers(0, 3)):
                at += int(rng.integers(0, 1200))
                end = at + int(rng.choice([5, 40, 250, 900]))
                spans.append((b"k%d" % i, kind, at, end))
                at = end
    # parts that share a character are one value, which is no evidence for itself
    want = {s for s in spans if s[1] in BASE or any(s[0] == t[0] and PART[t[1]] in NEEDS[PART[s[1]]] and 0 <= max(t[2] - s[3], s[2] - t[3]) <= SCOPE for t in spans)}
    d = spark.createDataFrame(spans, "key binary, kind string, start long, end long")
    got = [(bytes(r.key), r.kind, r.start, r.end) for r in link_parts(d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {s for s in spans if s[0] in (b"a", b"b")} & want == set(spans[:2])


def test_one_value_is_no_evidence_for_itself(spark):
    value, code = "aB3" * 11, "0123456789abcdef" * 2
    rows = [(1, f"client_id: {value}"), (2, f"user_id={code}"), (3, f"see https://x.org/{code}/a"), (4, f"user_id={code} auth: Zx9Zx9Zx9Zx9")]
    spans = {r.doc_id: r.spans for r in report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1] == "" and spans[2] == "hex:8:40" and spans[3] == "hex:18:50" and "weak_id:0:40" in spans[4] and "weak_secret:41:59" in spans[4]
