import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from listwright.llm import ctw as C
from tests.llm.conftest import SCHEMA


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


class BruteTree:
    """The context tree of one bit prefix, by recursion over the listed occurrences."""

    def __init__(self, seen, depth=0):
        self.a = sum(n for _, bit, n in seen if not bit)
        self.b = sum(n for _, bit, n in seen if bit)
        self.children = {}
        self.depth = depth
        estimate = kt(self.a, self.b)
        if depth == C.DEPTH:
            self.w, self.stop = estimate, 1.0
            return
        by = {}
        for context, bit, n in seen:
            by.setdefault(context[depth], []).append((context, bit, n))
        self.children = {c: BruteTree(own, depth + 1) for c, own in by.items()}
        below = sum(t.w for t in self.children.values())
        self.w = np.logaddexp(estimate, below) + math.log(0.5)
        self.stop = math.exp(math.log(0.5) + estimate - self.w)

    def p(self, context, bit):
        own = ((self.b if bit else self.a) + 0.5) / (self.a + self.b + 1)
        if self.depth == C.DEPTH:
            return own
        child = self.children.get(context[self.depth])
        return self.stop * own + (1 - self.stop) * (child.p(context, bit) if child else 0.5)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def occurrences(text):
    """(the bytes before, nearest first, byte) over the running text: words joined by one space, then the end."""
    padded = b"\n" * C.DEPTH + " ".join(words_of(text)).encode() + b"\n"
    for at in range(C.DEPTH, len(padded)):
        yield bytes(padded[at - d] for d in range(1, C.DEPTH + 1)), padded[at]


def brute_trees(texts):
    counts = Counter(x for t in texts for x in occurrences(t))
    seen = defaultdict(list)
    for (context, byte), n in counts.items():
        for k in range(8):
            seen[(256 | byte) >> (8 - k)].append((context, byte >> (7 - k) & 1, n))
    return {p: BruteTree(own) for p, own in seen.items()}


def brute_score(trees, text, memo):
    total = 0.0
    for context, byte in occurrences(text):
        if (context, byte) not in memo:
            nodes = [(trees.get((256 | byte) >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]
            memo[context, byte] = sum(math.log10(tree.p(context, bit) if tree else 0.5) for tree, bit in nodes)
        total += memo[context, byte]
    return total


def test_log_kt():
    x, y = np.array([0, 1, 7, 10**6, 3, 70_000]), np.array([0, 0, 2, 5, 10**8, 70_000])
    assert np.allclose(C.log_kt(x, x + y), [kt(a, b) for a, b in zip(x, y)], rtol=1e-10, atol=1e-6)


def test_grams_run_across_words_and_windows(monkeypatch):
    texts = ["ab cd", "", "x " * 40, "é"]
    bodies = [C.running_text(t.encode()) for t in texts]
    want = [(i, int.from_bytes(context + bytes([byte]), "big")) for i, t in enumerate(texts) for context, byte in occurrences(t)]
    for window in (1 << 22, 16, 7):
        monkeypatch.setattr(C, "WINDOW", window)
        got = [(int(o), int(k)) for keys, of in C.grams_of(bodies) for o, k in zip(of, keys)]
        assert got == want


def test_next_bytes_sum_to_one():
    trees = brute_trees(["ab ac ab", "b ab", "ac"])
    context = b"a" + b"\n" * (C.DEPTH - 1)
    total = 0.0
    for byte in range(256):
        p = 1.0
        for k in range(8):
            tree = trees.get((256 | byte) >> (8 - k))
            p *= tree.p(context, byte >> (7 - k) & 1) if tree else 0.5
        total += p
    assert total == pytest.approx(1.0)


@pytest.fixture(scope="module")
def expected(corpus):
    counts, train = Counter(), []
    for i, text, *_ in corpus:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(text), "\n"])
            train.append(text)
    trees, memo, n, v = brute_trees(train), {}, sum(counts.values()), len(counts)
    rows = []
    for i, text, *_ in corpus:
        words = [*words_of(text), "\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        rows.append((str(i), held, len(words), sum(counts[w] > 0 for w in words), n, base, brute_score(trees, text, memo)))
    return sorted(rows)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["lw_held"], r["lw_tokens"], r["lw_known"], r["lw_train_tokens"], r["lw_base"], r["lw_score"]) for r in df.collect())


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-7)


def test_texts(docs, corpus, nothing, clashing, expected):
    same(rows_of(C.score_texts(docs)), expected)
    assert all(r["lw_bits_per_byte"] > 0 for r in C.score_texts(clashing).collect())
    assert C.score_texts(nothing).count() == 0


def test_windows_and_tables_do_not_matter(docs, monkeypatch, expected):
    for name, value in (("WINDOW", 1000), ("HOT_TOKENS", 10), ("HOT_GRAMS", 64), ("_FLUSH_GRAMS", 5000), ("_ROWS", 50)):
        monkeypatch.setattr(C, name, value)
    same(rows_of(C.score_texts(docs)), expected)


def test_order_of_words_matters(spark, corpus):
    text = next(t for _, t, *_ in corpus if t and len(t.split()) > 80)
    rows = [(i, text, "en", "a", 0) for i in range(20)] + [(50, text, "en", "a", 0), (51, " ".join(sorted(text.split())), "en", "a", 0)]
    by = {r["doc_id"]: r for r in C.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by[50]["lw_base"] == pytest.approx(by[51]["lw_base"]) and by[50]["lw_score"] > by[51]["lw_score"] + 10


def test_counting_holds_little():
    """A task that counts grams holds no more than a few bounded pieces of them, however much text it gets."""
    import tracemalloc

    import pyarrow as pa

    from listwright.llm import ctw

    rng = np.random.default_rng(1)
    text = " ".join("".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (200_000, 5)))
    batch = pa.RecordBatch.from_arrays([pa.array([False]), pa.array([text])], names=["lw_held", "lw_text"])
    tracemalloc.start()
    n = sum(pa.compute.sum(out.column("lw_all")).as_py() for out in ctw._count_grams(iter([batch] * 16)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 16 * (len(text) + 1)
    assert peak < 200 << 20


def test_a_task_sends_each_gram_once():
    """Grams of later pieces are added to those counted before, and go to Spark in small batches."""
    import pyarrow as pa

    text = " ".join("".join(chr(97 + c) for c in w) for w in np.random.default_rng(2).integers(0, 26, (30_000, 5)))
    batch = pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array([text] * 2)], names=["lw_held", "lw_text"])
    out = list(C._count_grams(iter([batch] * 20)))
    grams = np.concatenate([x["lw_gram"].to_numpy() for x in out])
    assert len(grams) == len(set(grams.tolist())) and max(x.num_rows for x in out) <= C._BATCH
    for name, times in (("lw_n", 20), ("lw_all", 40)):
        assert sum(pa.compute.sum(x[name]).as_py() for x in out) == times * (len(text) + 1)
