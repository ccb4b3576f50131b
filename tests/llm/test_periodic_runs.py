import hashlib
import random
import time
import zlib
from fractions import Fraction

from edge import LONG, none, rows

from parcelwise.llm import periodic_runs as pr


def plain(words, least=6, times=4):
    """All runs, by trying every lag at every place."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = words[i : i + length]
                smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
                if not smaller:
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def cases():
    rng = random.Random(5)
    yield []
    yield ["a"] * 5
    yield ["a"] * 6
    yield "a b a b a b a".split()
    yield "a b a b a b a b".split()
    yield "x a b c a b c a b c a b c a y".split()
    yield ["a"] * 7 + ["b"] * 6 + ["a"] * 9
    yield ("a b " * 5 + "c " + "a b " * 5).split()
    # equal words at multiples of three, other words between them
    yield ("k a b " * 5 + "k c b " * 5 + "k a b " * 5).split()
    for kinds, size in ((1, 30), (2, 40), (2, 120), (3, 200), (4, 200)):
        for _ in range(12):
            yield [f"w{rng.randrange(kinds)}" for _ in range(size)]
    for _ in range(120):
        words = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            p = rng.randrange(1, 14)
            base = [f"w{rng.randrange(rng.choice((2, 9, 99)))}" for _ in range(p)]
            words += (base * 9)[: rng.randrange(3 * p, 7 * p + 2)]
            words += [f"w{rng.randrange(9)}" for _ in range(rng.randrange(9))]
        yield words


def test_runs_equal_a_plain_search():
    texts = list(cases())
    want = [plain(t) for t in texts]
    assert sum(map(len, want)) > 150
    encoded = [[w.encode() for w in t] for t in texts]
    assert pr.find_runs(encoded) == want  # all in one block
    assert [pr.find_runs([t])[0] for t in encoded] == want


def test_other_limits():
    texts = [t for t in cases() if len(t) < 150]
    for least, times in ((4, 3), (3, 3), (9, 5)):
        got = pr.find_runs([[w.encode() for w in t] for t in texts], least, times)
        assert got == [plain(t, least, times) for t in texts]


def test_collapse():
    words = [b"x", *[b"a", b"b"] * 5, b"y"]
    assert pr.collapse(words, pr.find_runs([words])[0]) == [b"x", b"a", b"b", b"y"]


def test_long_texts_stay_in_proportion():
    """One run over a million words, and words in random order that survive the splitting."""
    one = [b"a", b"b", b"c"] * 300_000
    rng = random.Random(2)
    two = [rng.choice((b"a", b"b", b"c", b"d")) for _ in range(200_000)]
    started = time.time()
    found = pr.find_runs([one, two])
    assert found[0] == [(0, 900_000, 3)] and time.time() - started < 60
    part = two[:1200]
    assert pr.find_runs([part])[0] == plain(part)


def tail(doc_id, words):
    """The rewritten words, word by word."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.doc_id: r for r in pr.query(spark, data).collect()}
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    some = planted = 0
    for d in docs:
        words = tail(d.doc_id, [w.decode() for w in (d.text or "").encode().split()])
        if len(words) > 1500:
            continue
        runs, r = plain(words), got[d.doc_id]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        if runs:
            s, length, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
            planted += zlib.crc32(str(d.doc_id).encode()) % 10 == 0
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        some += 1
    assert some > 100 and planted > 5


def test_edges(spark):
    got = pr.periodic_runs(rows(spark)).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[2].runs == by[3].runs == by[7].runs == [] and by[2].collapsed == by[7].collapsed == ""
    assert [tuple(r) for r in by[4].runs] == [(0, 54_000, 9)] and by[4].collapsed == LONG[:45]
    assert sum(r.doc_id == 5 for r in got) == 2
    ends = {r.doc_id: r for r in pr.summary(pr.periodic_runs(rows(spark), change=pr.repeated_tail)).collect()}
    assert ends[None].n_runs == 0
    assert pr.summary(pr.periodic_runs(none(spark))).count() == 0
