"""The registered queries against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from epochweave.llm.decontaminate import edit_distance_within
from epochweave.llm.queries import ORACLE_SQL, QUERIES
from test_pairs import plain_join

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names) and sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= entry.queries().keys()


def plain_lines(docs, min_sites=8):
    """Every line's sites counted one by one."""
    sites, first = {}, {}
    for r in docs:
        for at, line in enumerate((r.text or "").split("\n") if r.text is not None and r.doc_id is not None else []):
            if key := line.strip(" "):
                sites.setdefault(key, set()).add(r.source or "")
                first[key] = min(first.get(key, (r.doc_id, at)), (r.doc_id, at))
    bad = {k for k, of in sites.items() if len(of) >= min_sites}
    keep = lambda r, at, line: line.strip(" ") not in bad or first[line.strip(" ")] == (r.doc_id, at)
    return [None if r.text is None else r.text if r.doc_id is None else "\n".join(x for at, x in enumerate(r.text.split("\n")) if keep(r, at, x)) for r in docs]


def plain_passages(docs, items, share=0.2):
    """Every document held against every item."""
    normal = lambda text: " ".join(re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", text or "")).translate({c: c + 32 for c in range(65, 91)})
    items = [n for i in items if (n := normal(i))]
    return [any(edit_distance_within(i, text) <= int(share * len(i)) for i in items) for text in (normal(d.text) for d in docs)]


def check_stages(spark, docs, sf_dir):
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).cache()
        after = docs.collect()
        assert docs.columns == names, name
        plain = lambda rows: sorted(map(repr, rows))
        if "line" in name:
            assert sorted(map(repr, [(r.doc_id, r.text) for r in after])) == sorted(map(repr, zip((r.doc_id for r in before), plain_lines(before), strict=True)))
        else:
            assert not Counter(plain(after)) - Counter(plain(before)), name  # rows as they were
        if "Jaccard" in name:
            known = [r for r in before if r.doc_id is not None]
            classes = plain_join([(r.doc_id, r.text) for r in known], 5, 80)
            assert plain(after) == plain([r for r in before if r.doc_id is None or classes[r.doc_id][1] == r.doc_id])
        if "decontamination" in name:
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null").collect()]
            assert plain(after) == plain([r for r, hit in zip(before, plain_passages(before, items), strict=True) if not hit])
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in after)
    assert sum(r.n_words for r in packed) == sum(len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in after)
    return after


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(check_stages(spark, docs, SF)) > 0.5 * docs.count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    line = "a line that is on every one of the many sites"
    rows = [(i, f"{words(i, 40)}\n{line}", f"s{i}") for i in range(12)]
    rows += [(50, None, "s1"), (51, "", None), (52, " \n\n ", "s2"), (None, words(3, 40), "s3"), (None, None, None), (60, words(60, 9000), "s4"), (61, words(60, 9000) + " more", "s5"), (7, "the same id again", "s6"), (70, "x" * 200_000, "s7"), (71, words(71, 20) + " " + words(99, 30), "s8")]
    frame = spark.createDataFrame([(*r, "en", 1, 2, 3) for r in rows], "doc_id long, text string, source string, lang string, gone int, version int, _gone int")
    sf = f"file://{tmp_path}/sf"
    frame.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, words(99, 30)), (2, None), (3, ""), (None, "w1x1 w1x2")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = [r.doc_id for r in check_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)]
    assert 71 not in kept and 61 not in kept and {50, 51, 52, 60, 70} <= set(kept) and kept.count(None) == 2 and kept.count(7) == 2
    frame.limit(0).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
