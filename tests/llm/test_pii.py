import hashlib
import random
import re
import time

import numpy as np

from listwright.llm import pii as P
from tests.llm.conftest import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def cases():
    rng = random.Random(6)
    pieces = ["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (428) 555-8683", "+", "12", "0001.2.3.004", "é", " ", "-", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+49 30 1234567", "word", "\n", "4602179178647182"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + ["", "1" * 5000, "a" * 5000 + "@", "+1" + " " * 5000, "1." * 3000]


def test_base_spans_match_the_patterns():
    for text in cases():
        assert sorted(P.base_spans(text), key=lambda x: (x[1], x[0])) == brute(text), text


def test_very_long_runs_are_linear():
    for text in ("9" * 2_000_000, "a" * 2_000_000, "a" * 1_000_000 + "@" + "b" * 1_000_000, "1." * 500_000, "+1" * 300_000):
        P.loose_spans(text, P.base_spans(text))


def test_em_tells_reliable_labelers_from_noise():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.6
        vote = tuple(1 if (rng.random() < (right if true else wrong)) else -1 for right, wrong in ((0.95, 0.05), (0.9, 0.1), (0.5, 0.5), (0.85, 0.2)))
        counts[vote] = counts.get(vote, 0) + 1
    model = P.fit_reliabilities([(0, v, n) for v, n in counts.items()])
    assert model.right[0, 0] > 0.85 and model.wrong[0, 0] < 0.15
    assert abs(model.right[0, 2] - model.wrong[0, 2]) < 0.15
    high, low = model.posterior(np.array([0, 0]), np.array([(1, 1, 1, 1), (-1, -1, 1, -1)]))
    assert high > 0.9 > 0.1 > low


def brute_loose(text, base):
    """Leftmost first, each against all that is taken."""
    found = [(P.EMAIL, *m.span()) for m in P._SPELT.finditer(text)]
    found += [(P.CARD, *m.span()) for m in P._CARD.finditer(text) if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
    found += [(P.PHONE, *m.span()) for m in P._LOCAL_PHONE.finditer(text) if 7 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    found += [(P.SECRET, *m.span()) for m in P._SECRET.finditer(text) if P._mixed(m.group())]
    taken, out = [x[1:] for x in base], []
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        if all(e <= a or s >= b for a, b in taken):
            out.append((kind, s, e))
            taken.append((s, e))
    return out


def test_loose_spans_match_comparing_all():
    for text in cases()[:1500] + ["call 428-555-8683 or 4111 1111 1111 1112 token=24be64439e3e49cf46b2d7c9 x"]:
        base = P.base_spans(text)
        assert P.loose_spans(text, base) == brute_loose(text, base), text


def test_many_candidates_take_linear_time():
    text = "428-555-8683 " * 160_000
    began = time.process_time()
    assert len(P.loose_spans(text, P.base_spans(text))) == 160_000
    assert time.process_time() - began < 20


def test_planted_secrets_are_added(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        word = "x" * 30 if i % 2 else f'token = "{secret}"'
        rows.append((i, f"{prose(rng, 30)} {word} {prose(rng, 30)}"))
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        added = [text[s["start"] : s["end"]] for s in got[i]["lw_spans"] if not s["base"]]
        assert len(added) == (i % 2 == 0) and all(x in text.split('"') for x in added)


def test_table(spark, docs, corpus, clashing, nothing):
    texts = [(5000 + i, t, "en", "a", 0) for i, t in enumerate(cases()[:300])]
    texts += [(9000, "please mail jane.doe (at) example (dot) com or call 428-555-8683", "en", "a", 0)]
    both = docs.unionByName(spark.createDataFrame(texts, docs.schema))
    rows = P.find_personal_data(both).collect()
    assert len(rows) == len(corpus) + len(texts)
    want = {i: brute(t or "") for i, t, *_ in [*corpus, *texts]}
    for r in rows:
        if r["doc_id"] is None:
            continue
        base = want[r["doc_id"]]
        assert r["lw_base_sha256"] == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert [r[f"lw_n_{k}"] for k in P.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        got = [(P.SPAN_KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["lw_spans"]]
        assert set(base) <= set(got) and got == sorted(got, key=lambda x: (x[1], x[0]))
    assert P.find_personal_data(nothing).count() == 0
    assert P.find_personal_data(clashing).count() == len(corpus)
