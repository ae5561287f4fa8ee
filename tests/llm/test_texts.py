"""Operators on texts, against plain versions, held-out labels and round trips, and on odd inputs."""

import base64
import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochweave.llm.chat import Windows, escape, format_chats, read_chats, unescape
from epochweave.llm.decontaminate import contaminated_passages, edit_distance_within, find, prepare, without_contaminated
from epochweave.llm.line_dedup import line_dedup
from epochweave.llm.packing import best_fit, best_fit_packing
from epochweave.llm.quality import classify_quality
from epochweave.llm.queries import END_OF_DOCUMENT, VOCABULARY
from epochweave.llm.secrets import CANDIDATE, ENDS, candidates, default_forest, features, forest, labelled_findings, scored, secret_scan
from epochweave.llm.shared import fresh_path
from epochweave.llm.token_counts import count_tokens, document_token_counts
from epochweave.llm.warc import page_records, read_warc, write_warc

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Quality


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    rows = classify_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "some text", 0), (2, "x" * 300_000, 0)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([(1, 1, 1), (2, None, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    rows = classify_quality(docs, none).collect()
    assert len(rows) == 4 and all(abs(r.score - 0.5) < 1e-9 for r in rows)  # without both labels, nothing is preferred
    assert classify_quality(docs.limit(0), none).count() == 0


# Lines


def test_line_dedup(spark):
    line, rare = "this line stands on very many sites", "this line stands on a few sites only"
    rows = [(i, f"own {i} words that no other has\n{line}\nshort {i // 7}" + (f"\n{rare}" if i < 7 else ""), f"s{i}", 5) for i in range(12)]
    rows += [(100, None, "s1", 0), (101, "", None, 0), (None, line, "s3", 1), (5, rows[5][1], "s5", 5)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 12:
            assert (line in r.text) == (r.doc_id == 0) and "short" in r.text and (rare in r.text) == (r.doc_id < 7)
            assert r.n_chars == len(r.text) and r.n_removed == (r.doc_id > 0)
    by = {r.doc_id: r for r in out}
    assert by[100].text is None and by[100].n_lines == 0 and by[101].text == "" and by[101].n_lines == 1 and by[None].text == line
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_line_dedup_of_short_lines(spark):
    rows = [(i, f"Menu\nown {i}\n" + ("Les." if i < 7 else "x"), f"s{i}") for i in range(40)]
    out = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == "Menu\nown 0\nLes." and all(out[i] == f"own {i}\n" + "Les." for i in range(1, 7)) and out[7] == "own 7\nx" and all(out[i] == f"own {i}" for i in range(8, 40))


def test_line_dedup_whatever_columns_are_called(spark):
    line = "this line stands on very many sites"
    rows = [(i, f"own {i}\n{line}", f"s{i}", i, 2, 3, 4, 5, 6, 7) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string, gone int, _text int, _doc int, version int, row int, lines int, n_removed int")
    out = sorted(line_dedup(frame).collect(), key=lambda r: r.doc_id)
    assert line_dedup(frame).columns == [*frame.columns[:-1], "n_lines", "n_removed"]
    assert [(r.gone, r._text, r._doc, r.version, r.row, r.lines, r.n_lines, r.n_removed) for r in out] == [(i, 2, 3, 4, 5, 6, 2, int(i > 0)) for i in range(9)]
    assert [r.text for r in out] == [f"own 0\n{line}"] + [f"own {i}" for i in range(1, 9)]


def test_line_dedup_is_linear_in_a_text_and_native(spark):
    many = [f"boilerplate line number {i} of them all" for i in range(100_000)]
    rows = [(0, "\n".join(many), "s0")] + [(i, "\n".join(many[i % 2 :: 2]), f"s{i}") for i in range(1, 9)] + [(9, "own line that none else has\n" + "\n".join(many), "s9")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(frame, min_sites=5).collect()}
    assert time.time() - began < 60
    assert out[9] == ("own line that none else has", 100_001, 100_000) and out[0][2] == 0 and out[3] == ("", 50_000, 50_000)
    plan = line_dedup(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Decontamination


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert edit_distance_within(a, b) == plain_distance(a, b)


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 50)))) for i in range(60)]
    docs, hit = [], set()
    for i in range(300):
        words = [word() for _ in range(rng.randrange(5, 200))]
        if i % 3 == 0:
            item = items[i % 60][1].split()
            for _ in range(len(item) // 12):
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(words))
            words[at:at] = item
        docs.append((i, " ".join(words)))
        norm = " ".join(re.findall(r"[^\W_]+", docs[-1][1]))
        hit |= {(i, k) for k, t in items if plain_distance_bound(t, norm)}
    odd = [(1000, None), (1001, ""), (None, items[0][1].upper() + "!")]
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (None, "some words here")], "item_id long, text string")
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated_passages(frame, bench).collect()}
    assert (None, 0) in got and not got - hit - {(None, 0)}
    assert len(got & hit) >= 0.95 * len(hit) and len(hit) >= 90
    kept = {r.doc_id for r in without_contaminated(frame, bench).collect()}
    assert kept == {i for i, _ in docs + odd} - {i for i, _ in got}
    assert contaminated_passages(frame, bench.limit(0)).count() == 0 and contaminated_passages(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.19, 0.2])
def test_decontamination_finds_character_edits(rate):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéñ1") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts = []
    for item in items:
        chars = list(item)
        for at in sorted(rng.sample(range(len(chars)), int(rate * len(chars))), reverse=True):
            chars[at : at + 1] = rng.choice([[], ["q"], ["q", chars[at]], ["q"]])  # letters only, also in place of spaces
        texts.append(" ".join(word() for _ in range(rng.randrange(3))) + " " + "".join(chars) + " " + word())
    texts += [None, "", " ".join(word() for _ in range(300))]
    norm = [" ".join(re.findall(r"[^\W_]+", t or "")) for t in texts]
    want = {(i, k): edit_distance_within(item, t) for i, t in enumerate(norm) for k, item in enumerate(items) if t and plain_distance_bound(item, t)}
    got = {(i, h["item_id"]): h["distance"] for i, hits in enumerate(find(pa.array(texts), prepare(list(range(60)), items), 0.2)) for h in hits}
    assert got == want and {(k, k) for k in range(60)} <= want.keys()


def plain_distance_bound(item, text):
    return edit_distance_within(item, text) <= 0.2 * len(item)  # itself held against plain_distance above


def test_short_items_match(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, BETA y"), (2, "alpha gamma"), (3, "the zeta.")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated_passages(docs, items).collect()} == {(1, 1), (3, 2)}
    assert prepare([], []).ids == []


# Packing


def each(of):
    return [[] if x is None else [x] for x in of]


def test_best_fit_takes_the_tightest_compatible_bin():
    assert best_fit([6, 5, 4, 3], each("abcd"), each([1, 2, 3, 4]), 10) == [0, 1, 0, 1]
    assert best_fit([6, 5, 4, 3], each("abad"), each([1, 2, 3, 4]), 10) == [0, 1, 1, 0]  # 4 can't join its source
    assert best_fit([6, 5, 4], each("abc"), each([9, 2, 9]), 10) == [0, 1, 1]  # nor its cluster
    assert best_fit([5, 5], each([None, None]), each([None, None]), 10) == [0, 0]
    assert best_fit([5, 3, 2], [["a", "b"], ["c", "b"], ["c"]], [[], [], []], 10) == [0, 1, 0]


def plain_best_fit(sizes, sources, clusters, capacity):
    """Every bin looked at for every piece."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(b["n"]) - size, k) for k, b in enumerate(bins) if sum(b["n"]) + size <= capacity and not set(s) & b["s"] and not set(c) & b["c"]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"n": [], "s": set(), "c": set()})
        bins[k]["n"].append(size)
        bins[k]["s"] |= set(s)
        bins[k]["c"] |= set(c)
        out.append(k)
    return out


def test_best_fit_is_what_looking_at_every_bin_gives():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randrange(1, 200)
        sizes = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
        of = lambda k, most: [rng.sample(range(k), rng.randrange(most)) for _ in range(n)]
        args = (sizes, of(rng.choice([3, 50]), 3), of(40, 2), 100)
        assert best_fit(*args) == plain_best_fit(*args)


def test_packing_of_one_pack_is_best_fit_over_all(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(["w%d" % i] * rng.randrange(1, 100)), f"s{rng.randrange(30)}") for i in range(200)]
    docs += [(500 + i, docs[i][1].upper(), "s31") for i in range(5)]
    rows = best_fit_packing(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), capacity=100).collect()
    got = {r.doc_id: r.bin_id for r in rows}
    order = sorted(docs, key=lambda d: (-len(d[1].split()), d[0]))
    want = plain_best_fit([len(d[1].split()) for d in order], [[d[2]] for d in order], [[d[1].lower()] for d in order], 100)
    assert [got[d[0]] for d in order] == want


@pytest.mark.parametrize("pack_rows", [120, 16, 4096])
def test_packing_keeps_its_rules(spark, pack_rows):
    rng = random.Random(2)
    docs = [(i, " ".join(["w%d" % rng.randrange(50)] * rng.randrange(1, 90)), f"s{rng.randrange(3) if rng.random() < 0.5 else i % 40}") for i in range(400)]
    docs += [(1000, None, "s1"), (1001, " ", "s1"), (1002, " ".join(["long"] * 250), None), (1003, " ".join(["LONG"] * 250), "s2"), (1003, "twice", "s9"), (None, "no id", "s4")]
    rows = best_fit_packing(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=100, pack_rows=pack_rows).collect()
    words = {}
    for i, text, source in docs:
        words.setdefault(i, []).append((len((text or "").split()), source, (text or "").lower()))
    bins = {}
    for r in rows:
        if r.bin_id is None:
            assert r.n_words == 0 and r.doc_id in (1000, 1001)
        else:
            bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.n_words for r in rows) == sum(n for v in words.values() for n, _, _ in v)
    for own in bins.values():
        assert sum(r.n_words for r in own) <= 100
        known = [words[r.doc_id][0] for r in own if len(words[r.doc_id]) == 1]
        sources = [s for _, s, _ in known if s]
        assert len(sources) == len(set(sources)) and len({t for _, _, t in known}) == len(known)
    least = len({r.bin_id for r in best_fit_packing(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=100).collect()})
    assert len(bins) <= 1.15 * least  # open bins of many packs are joined
    assert [(r.piece, r.begin_word, r.n_words) for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 1002] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# Tokens


def test_token_counts_across_blocks(spark):
    import tiktoken

    from epochweave.llm.vocabulary import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()] + [(9001, None), (9002, ""), (9003, "<|endoftext|>"), (None, "x"), (9003, "again")]
    want = sorted((i or -1, len(encode(t or ""))) for i, t in rows)
    for block in (1 << 20, 97):
        got = document_token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), VOCABULARY, END_OF_DOCUMENT, block_tokens=block)
        assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == want
    assert document_token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, END_OF_DOCUMENT).count() == 0


def test_files_without_a_last_separator(spark, tmp_path):
    import numpy as np

    np.array([5, 9, 7, 7, 7, 9, 9, 3], "uint16").tofile(tmp_path / "a.tokens")
    (tmp_path / "b.tokens").write_bytes(b"")
    for block in (100, 2, 1):
        got = count_tokens(spark, f"file://{tmp_path}", 9, block_tokens=block).collect()
        assert sorted((r.place, r.n_tokens) for r in got) == [(0, 1), (1, 3), (2, 0), (3, 1)]


# WARC


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_warc_round_trip(spark, min_bytes):
    pages = [(1, "http://a/ b", "same"), (2, None, "same"), (7, "http://c", "same"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "WARC/1.1\r\n\r\né " * 30_000), (6, "u", "WARC/1.1\r\n\r\né " * 30_000), (None, "n", "same"), (8, "r", "twice"), (8, "r", "twice")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    chunks = read_warc(write_warc(frame, min_bytes=min_bytes), chunk_bytes=1000)
    got = sorted((tuple(r) for r in page_records(chunks).collect()), key=str)
    groups = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= min_bytes:
            groups.setdefault(html or "", []).append(i)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        last = max(groups.get(html or "", [i]) or [i]) if i is not None else None
        revisit = i is not None and i < last
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    long = chunks.where("record_id = '<urn:page:6>'").orderBy("chunk").collect()
    assert len(long) > 100 and b"".join(r.data for r in long) == pages[6][2].encode() and long[3].digest == hashlib.sha1(pages[6][2].encode()[:4000]).digest()
    assert page_records(read_warc(write_warc(frame.limit(0)))).count() == 0


# Chats


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "a", "\n"]) for _ in range(rng.randrange(30)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_chats_read_back(spark):
    rng = random.Random(4)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(rng.choice(["word", "<|im_end|>\n", "<\\|", "été"]) for _ in range(rng.randrange(0, 60)))) for c in range(12) for t in range(rng.randrange(1, 30))]
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (50, 1, "a%\nb", "x"), (51, 0, "assistant", "y" * 9000), (51, 1, "assistant", "z"), (51, 1, "assistant", "z"), (None, 3, "user", "q")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = format_chats(frame, VOCABULARY, budget=100, history=40)
    got = {r.conv_id: r for r in read_chats(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    shown = windows.where("conv_id is not null").orderBy("conv_id", "window").collect()
    assert any(w.n_repeated for w in shown) and all(w.window == 0 or not w.n_repeated or "system" in w.text.split("\n")[0] for w in shown if w.conv_id in (1, 3, 5))
    assert all(w.tokens <= 100 or w.text.count("<|im_start|>") == 1 for w in shown)  # only a turn alone may have more
    assert read_chats(format_chats(frame.limit(0), VOCABULARY)).count() == 0


def test_windows_keep_within_their_budget():
    rng = random.Random(3)
    for _ in range(300):
        budget, history = rng.randrange(20, 100), rng.randrange(0, 60)
        turns = [("system" if i == 0 and rng.random() < 0.5 else ("user", "assistant")[i % 2], f"t{i}", rng.randrange(1, budget + 1)) for i in range(rng.randrange(1, 40))]
        windows = Windows(1, budget, history)
        rows = [w for t in turns for w in windows.add(*t)] + list(windows.end())
        assert all(tokens <= budget for *_, tokens in rows)
        texts = [re.findall(r"<\|im_start\|>(\w+)\n(\w+)<", text) for _, _, _, text, _, _ in rows]
        assert [t for of, row in zip(texts, rows, strict=True) for t in of[row[2] :]] == [t[:2] for t in turns]
        for of, row in zip(texts[1:], rows[1:], strict=True):
            first = next(t[2] for t in turns if t[:2] == of[row[2]])
            assert turns[0][0] != "system" or of[0] == turns[0][:2] or turns[0][2] + first > budget


# Secrets


def test_forest_on_other_findings(spark):
    held = labelled_findings(spark, seed=5, rows=1000)
    rows = scored(default_forest(spark), held).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in rows) / len(rows) > 0.93


def test_labelled_findings_are_candidates_of_their_texts(spark):
    held = [r for r in labelled_findings(spark, seed=6, rows=1000).collect() if r.label]
    more = [("API_KEY=", "0f3a" * 8), ("see client_secret=", "QmFzZTY0" * 3 + "Zg=="), ("password: ", "Tr0ub4!"), ('"passwd": "', "a.b#c$d@e!"), ("AWS_SECRET_KEY_NUMBER_2=", "k9" * 20), ("/?token=", "k9" * 20)]
    rows = [(r.before, r.candidate, r.after) for r in held] + [(b, c, '"' if b.endswith('"') else "&x=1" if "?" in b else ", so") for b, c in more]
    docs = spark.createDataFrame([(i, b + c + a, "web") for i, (b, c, a) in enumerate(rows)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.begin, r.candidate, r.before) for r in candidates(docs).collect()}
    assert not [row for i, row in enumerate(rows) if (i, len(row[0]), row[1], row[0][-48:]) not in found]
    reported = {(r.doc_id, r.begin) for r in secret_scan(docs).collect()}
    assert sum((i, len(b)) in reported for i, (b, _, _) in enumerate(rows)) > 0.93 * len(rows)


def test_secret_scan(spark):
    key = hashlib.sha1(b"k").hexdigest()
    text = f'Words of a page.\ntoken = "{key}" and so on. See commit {hashlib.sha1(b"c").hexdigest()} or 4412473014894482 there.'
    docs = spark.createDataFrame([(1, text, "web", 3), (2, None, None, 3), (3, "", "a", 3), (None, text, None, 3), (4, "a1" * 50_000, "x", 3)], "doc_id long, text string, source string, begin int")
    found = [(r.doc_id, r.candidate) for r in candidates(docs).where("doc_id = 1").collect()]
    assert len(found) == 3
    assert all(text[r.begin :].startswith(r.candidate) for r in candidates(docs).where("doc_id = 1").collect())
    got = secret_scan(docs).where("doc_id = 1 or doc_id is null").collect()
    assert {(r.doc_id, r.begin, r.n_chars, r.sha256) for r in got} == {(i, text.index(key), 40, hashlib.sha256(key.encode()).hexdigest()) for i in (1, None)}
    assert secret_scan(docs.limit(0)).count() == 0
    plan = secret_scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan



def test_candidates_stand_where_they_say(spark):
    rng = random.Random(11)
    bit = lambda: rng.choice(["token=", "password: ", '"api_key": "', "é ", "\n", "word ", "x" * 60, hashlib.sha1(str(rng.random()).encode()).hexdigest(), "a1B2" * 5, "Tr0ub4!", '" '])
    texts = ["".join(bit() for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["a\x01b\x02 token=" + "k9" * 12]
    got = {}
    for r in candidates(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got) > 40
    for i, rows in got.items():
        text = texts[i].translate({1: " ", 2: " "})
        rows.sort(key=lambda r: r.begin)
        assert all(text[r.begin : r.begin + len(r.candidate)] == r.candidate for r in rows)
        ends = [r.begin + len(r.candidate) for r in rows]
        assert all(a <= r.begin for a, r in zip(ends, rows[1:], strict=False))
        for k, r in enumerate(rows):
            back = rows[k - 8].begin + len(rows[k - 8].candidate) if k >= 8 else 0
            assert r.before == text[max(0, r.begin - 48) : r.begin] or (len(r.before) < 48 and text[: r.begin].endswith(r.before) and r.begin - back < 48)
            assert text[ends[k] :].startswith(r.after) and (len(r.after) == min(24, len(text) - ends[k]) or k + 8 < len(rows))


def plain_candidates(text):
    """The stated rule, by one search after the other of a text without marks."""
    import regex

    pattern = CANDIDATE.replace("(?i:", "(?i:")
    out = []
    for m in regex.finditer(pattern, text):
        value = m[0]
        if text[m.end() : m.end() + 1] not in ("'", '"', "`") or not text[m.end() : m.end() + 1]:
            core = value.rstrip(ENDS)
            value = core + "=" * min(2, len(value[len(core) :]) - len(value[len(core) :].lstrip("=")))
        out += [(m.start(), value)] if value else []
    return out


def test_candidates_are_those_of_a_plain_search(spark):
    rng = random.Random(21)
    bit = lambda: rng.choice(["token=", "password: ", '"api_key": "', "secret = '", "auth_x==", "é😀", "\n", "word ", "&x=1", "&", "=", "===", ")", "].", ";", "a1B2" * 5, "QmFz" * 5 + "==", "Tr0ub4!", '"', "'", "`", "ghp_" + "Ab" * 9, hashlib.sha1(str(rng.random()).encode()).hexdigest()])
    texts = ["".join(bit() for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    rows = candidates(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.begin, r.candidate) for r in rows) == sorted((i, *c) for i, t in enumerate(texts) for c in plain_candidates(t))
    assert all(r.candidate for r in rows) and len(rows) > 600


def test_no_text_is_too_odd_to_be_searched(spark):
    mixed = "a😀" * 20_000
    texts = [f"password={mixed}", "token=" + ")" * 50_000, "secret=" + "&" * 50_000, "token=" + "=" * 50_000, "api_key=" + "&a" * 30_000, "auth: " + "é" * 100_000, "password" * 20_000 + "=", "private" + "=" * 3 + " " * 50_000, "x" * 300_000, "-/" * 100_000 + "1"]
    rows = {r.doc_id: r for r in candidates(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    assert rows[0].candidate == mixed and rows[0].begin == 9 and 1 not in rows and rows[2].candidate == "&" * 50_000 and 3 not in rows and len(rows[4].candidate) == 60_000 and len(rows[5].candidate) == 100_000
    assert secret_scan(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")).count() >= 0


def test_scores_are_the_votes_of_the_trees(spark):
    """Each tree walked by hand, from its printed form."""
    held = labelled_findings(spark, seed=8, rows=200)
    model = forest(labelled_findings(spark, rows=600), trees=5, depth=4)
    names = list(features())
    rows = held.select(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in features().items()]).collect()
    got = [r.score for r in scored(model, held).collect()]

    def leaf(node, row):
        while node.subtreeDepth():
            split = node.split()
            node = node.leftChild() if row[names[split.featureIndex()]] <= split.threshold() else node.rightChild()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    trees = [t._call_java("rootNode") for t in model.stages[1].trees]
    for row, score in list(zip(rows, got, strict=True))[:60]:
        assert abs(sum(leaf(t, row) for t in trees) / len(trees) - score) < 1e-9


def test_many_candidates_in_one_text_take_seconds(spark):
    text = " ".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(50_000))
    began = time.time()
    rows = candidates(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, source string")).agg({"begin": "max", "candidate": "count"}).first()
    assert rows["count(candidate)"] == 50_000 and rows["max(begin)"] == 41 * 49_999 and time.time() - began < 60


def test_forest_learns_from_findings_of_other_rules(spark):
    """Findings whose values, names and surroundings come from other rules than labelled_findings(): half teach, half are held out."""
    rng = random.Random(12)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secret = lambda: ("".join(rng.choice(chars) for _ in range(rng.randrange(20, 50))), f"export {rng.choice(['SERVICE', 'DB', 'MAIL'])}_{rng.choice(['AUTH', 'SECRET', 'PASSWD'])}=", "\n", "deploy/env")
    harmless = lambda: rng.choice([
        ("-".join(rng.choice(["layer", "block", "norm", "head", "proj"]) for _ in range(4)) + f"-{rng.randrange(10, 99)}", "loading ", " done", "logs/run"),
        ("".join(rng.choice("0123456789") for _ in range(20)), "invoice ", ".", "mail"),
        ("".join(rng.choice("0123456789abcdef") for _ in range(64)), "sha256: ", "\n", "pkg/lock"),
    ])
    rows = [(*secret(), 1) if i % 2 else (*harmless(), 0) for i in range(1200)]
    frame = spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int").withColumn("n", F.monotonically_increasing_id())
    held = scored(forest(frame.where("n % 4 < 2").drop("n")), frame.where("n % 4 >= 2")).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in held) / len(held) > 0.95
    every = scored(default_forest(spark), frame).collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in every) / len(every) > 0.8  # rules that it never saw


# Several blocks of items


def test_items_in_several_blocks(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))
    items = [(k, words(20)) for k in range(12)] + [(50, None), (None, words(20))]
    docs = [(k, f"{words(30)} {items[k % 12][1]} {words(30)}" if k % 3 else words(60)) for k in range(40)] + [(90, None), (None, items[3][1]), (91, words(20_000) + " " + items[5][1])]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, item_id int, hit int, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = plain(contaminated_passages(frame, bench))
    assert one == plain(contaminated_passages(frame, bench, block_chars=300)) and {(r[0], r[1]) for r in one} >= {(k, k % 12) for k in range(40) if k % 3} | {(None, 3), (91, 5)}
    kept = without_contaminated(frame, bench, block_chars=300)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [*range(0, 40, 3), 90]
