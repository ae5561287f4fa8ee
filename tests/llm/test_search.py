"""Lexical search, spelling variants and URL filters against plain versions, and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from epochweave.llm.lexical import build_index, item_terms, queries_of, ranked_search, search
from epochweave.llm.spelling import near_pairs, one_edit, pairs_one_edit_apart, spelling_variants
from epochweave.llm.url_filter import RULES, SLOTS, host_of, judged_urls, labelled_urls, path_of, strength, train

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


# Search


def plain_search(docs, items, top=20):
    """Every document's score for every item."""
    terms = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    own: dict = {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, Counter()).update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)))
    out = []
    for item, wanted in own.items():
        scores = []
        for i, c in terms:
            m = 75 + 25 * c.total() * n // max(total, 1)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if c[t])
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def made_up(seed, n):
    """Documents of common and of rare words, so that the high tiers are enough for some items."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    return [(i, " ".join(word() for _ in range(rng.choice([3, 30, 200])))) for i in range(n)]


def test_search_against_every_score(spark):
    docs = made_up(1, 400)
    items = [(k, docs[7 * k][1][:150]) for k in range(20)] + [(90, "w1 w2 w1 W1"), (91, "unseen"), (92, "w77 w1")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    assert searched(ranked_search(d, i)) == want
    assert searched(ranked_search(d, i, block=40)) == want  # several blocks of items
    own = queries_of(item_terms(i).toArrow())
    ranks, done = search(build_index(d, own.term), own)
    assert searched(ranks) == want and sum(done) == len(own.items) and sum(done[:-1]) > 0  # some are proven above the last tier
    assert searched(search(build_index(d, own.term, ()), own)[0]) == want  # one tier
    assert searched(search(build_index(d, own.term, (0.5, 0.9)), own, most=400)[0]) == want


def test_search_of_odd_tables(spark):
    same = "alpha beta gamma"
    docs = [(1, None), (2, ""), (None, same), (3, same), (4, same), (5, "ALPHA é-é"), (5, "alpha"), (6, "x " * 300_000 + "alpha"), (7, "-- !!"), (None, None)] + [(100 + k, f"other{k} words{k}") for k in range(30)]
    items = [(1, "alpha alpha é"), (1, "beta"), (2, None), (3, ""), (None, "alpha"), (4, "... "), (5, "é")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id int, text string, item_id int, shard int, score int")
    asked = spark.createDataFrame([(*r, 4, 5) for r in items], "item_id int, text string, doc_id int, rank int")
    assert searched(ranked_search(frame, asked)) == plain_search(docs, items)
    assert searched(ranked_search(frame, asked, top=2)) == plain_search(docs, items, 2)
    assert ranked_search(frame.limit(0), asked).count() == 0 and ranked_search(frame, asked.limit(0)).count() == 0


# Spelling


def plain_variants(docs, one_in=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % one_in == 0 else low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return sorted(((w, form.get(w), root[w], n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=lambda r: r[0])


def plain_one_edit(a, b):
    """By making all strings one edit from a with b's characters."""
    some = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in set(b) for k in (0, 1)}
    return a != b and b in some


def test_one_edit():
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(200)}
    assert all(one_edit(a, b) == plain_one_edit(a, b) for a in words for b in words)


def test_near_words_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    words = set(base) | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"}
    for w in base:  # edits everywhere, ends included
        for _ in range(4):
            at = rng.randrange(len(w))
            words |= {x for x in (w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :], w + "a", "b" + w) if len(x) >= 6}
    words |= {f"common{a}{b}" for a in "abcdefghij" for b in "abcdefghij"}  # many that share most of their q-grams
    words = sorted(words)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    column = pa.array(words)
    assert {(words[min(a, b)], words[max(a, b)]) for a, b in zip(*near_pairs(column, np.zeros(len(words), np.int64)), strict=True)} == want and len(want) > 900
    block = np.arange(len(words)) // 50
    assert {(min(a, b), max(a, b)) for a, b in zip(*map(np.ndarray.tolist, near_pairs(column, block)), strict=True)} == {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if a // 50 == b // 50 and one_edit(words[a], words[b])}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for most in (1024, 16, 2):  # small blocks go on to more q-grams, and to parts
        assert {tuple(r) for r in pairs_one_edit_apart(frame, most).collect()} == want


def test_spelling_variants_of_odd_tables(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["Abwechslung"] * 30 + ["straße"] * 9 + ["abwechslng", "ABWECHSLUNG", "abwechslungg", "strasse", "strase", "niñería", "kurz", "abwechsl×ng"]) for _ in range(400))
    docs = [(i, text()) for i in range(60)] + [(None, "Abwechslung " * 50), (3, None), (4, ""), (5, "x" * 100_000 + " ÀÿÀÿÀÿ"), (5, "Abwechslung"), (5, "Abwechslung"), (6, "1abwechs2abwechs_abwechs-ABWECHS abwechs")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id int, text string, word int, n int")
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in spelling_variants(frame).select(*names).collect()), key=lambda r: r[0])
    assert got == plain_variants(docs) and any(r[1] for r in got)
    assert sorted((tuple(r) for r in spelling_variants(frame, one_in=3).select(*names).collect()), key=lambda r: r[0]) == plain_variants(docs, 3)
    assert spelling_variants(frame.limit(0)).count() == 0


def test_forms_of_forms(spark):
    chain = [("abcdefg", 700), ("abcdefh", 100), ("abcdegh", 20), ("abcdxgh", 4)]
    docs = [(k, " ".join(f"{w}" for _ in range(n * 2))) for k, (w, n) in enumerate(chain)]
    rows = {r.word: r for r in spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), one_in=10**9).collect()}
    assert {r.root for r in rows.values()} == {"abcdefg"} and rows["abcdxgh"].form == "abcdegh" and rows["abcdxgh"].form_n == 40


# URLs


def test_hosts_paths_and_rules(spark):
    urls = [
        ("https://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://a.org/Q", "a.org", "/Q", "org/", "allow"), ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), ("http://com/de/x/y", "com", "/de/x/y", "com/de/", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://a.org", "a.org", "", None, None), ("http://a.org?q=/es/", "a.org", "", None, None), ("http://b.com/FR/", "b.com", "/FR/", None, None), ("http://b.com/fr", "b.com", "/fr", None, None), ("//b.com/fr/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("http://u@b.com:80/fr/#a", "u@b.com:80", "/fr/", None, None), ("a\nb://É.Org/ü/x?://y", "É.org", "/ü/x", "org/", "allow"), ("http://q://z/w", "q:", "//z/w", None, None), ("http://b.com/" + "é" * 100_000, "b.com", "/" + "é" * 100_000, None, None),
    ]
    pages = spark.createDataFrame([(k, u[0], "x", 1, 2) for k, u in enumerate(urls)] + [(None, urls[0][0], "x", 1, 2)] * 2, "page_id long, url string, host string, score int, rule int")
    rows = judged_urls(pages).collect()
    assert len(rows) == len(urls) + 2 and sum(r.page_id is None for r in rows) == 2
    for r in rows:
        _, host, path, rule, verdict = urls[r.page_id or 0]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert judged_urls(pages.limit(0)).count() == 0
    rules = [("a.b", "/c", "allow"), ("b", "/", "block")]
    got = judged_urls(spark.createDataFrame([(1, "h://x.a.b/cd"), (2, "h://x.a.b/d"), (3, "h://xa.b/")], "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(1, "a.b/c", "allow"), (2, "b/", "block"), (3, "b/", "block")] and len(RULES) == 5


def test_urls_on_held_out_labels(spark):
    known = labelled_urls(spark)
    weights, intercept = train(known.where(F.crc32("url") % 5 != 0))
    held = known.where(F.crc32("url") % 5 == 0).withColumn("s", strength(weights, host_of(F.col("url")), path_of(F.col("url"))) + intercept).collect()
    assert len(weights) == SLOTS and len(held) > 800 and sum((r.s >= 0) == (r.label == 1) for r in held) / len(held) > 0.93
    flat, low = train(known.where("label = 1"))
    assert not any(flat) and low < 0


def test_strength_is_that_of_the_ngrams_one_by_one(spark):
    import xxhash

    weights = np.random.default_rng(1).normal(size=64).round(6).tolist()
    urls = ["http://ab.com/x/yz", "x://h", "none", "http://éa.org/" + "p" * 40]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", strength(weights, host_of(F.col("url")), path_of(F.col("url"))).alias("s")).collect()
    for r in rows:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url)
        total = 0.0
        for part, text in enumerate(found.groups() if found else ("", "")):
            marked = f"^{text}$"
            grams = [marked[i : i + n] for n in (3, 4) for i in range(max(len(marked) - n, 0) + 1)]
            slots = [int(np.int64(np.uint64(xxhash.xxh64(g.encode(), seed=42).intdigest()))) % 32 + 32 * part for g in grams]
            total += sum(weights[s] for s in slots) / len(slots)
        assert abs(total - r.s) < 1e-9
