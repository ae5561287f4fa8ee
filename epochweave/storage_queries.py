"""Queries that write a table in one of the formats and read it back."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from epochweave.feeds.plan_feed import plan_feed, write_plan
from epochweave.operators.convert import LAYOUTS, as_layout
from epochweave.places import filesystem, remove, shared_folder
from epochweave.plan_queries import _STOPPED, EVERY, WEIGHTS, WORLD, _planner
from epochweave.plan_sql import ALL, SAMPLES, SHARD_ROWS, draw, grid, shuffled
from epochweave.plans.epoch import Planner, samples_of
from epochweave.registry import query, table
from epochweave.sources.lines import read_by_index, write_json_lines, write_separated
from epochweave.sources.index import merge_groups, merge_index, read_index
from epochweave.sources.shards import read_shards, stream_to_shards, write_shards


@query("w2_shards_round_trip", "select doc_id, text, lang, n_chars from documents")
def w2(spark, sf_dir):
    folder = shared_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), folder, size_limit="256kb", compression="zstd:3", hashes="sha1,xxh64")
    return read_shards(spark, folder, validate="sha1").select("doc_id", "text", "lang", "n_chars")


@query("w7_two_appends", "select doc_id, n_chars from documents union all select page_id, length(html) from pages")
def w7(spark, sf_dir):
    folder = shared_folder(spark, "appended")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), folder)
    write_shards(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("n_chars")), folder)
    return read_shards(spark, folder).select("doc_id", "n_chars")


@query("w7_overwrite", "select page_id, url from pages")
def w7_overwrite(spark, sf_dir):
    folder = shared_folder(spark, "replaced")
    write_shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("url")), folder)
    write_shards(table(spark, sf_dir, "pages").select("page_id", "url"), folder, mode="overwrite")
    return read_shards(spark, folder).select("page_id", "url")


@query(
    "w10_merged_groups",
    "with g as (select lang, row_number() over (order by lang) - 1 as shard_id, count(*) as n from documents group by lang) select shard_id, n, sum(n) over (order by shard_id) - n as first_sample from g",
)
def w10(spark, sf_dir):
    """A shard for each language, all written by one job to folders of their own, then merged into one folder under running numbers."""
    folder = shared_folder(spark, "groups")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(0).alias("number")), folder, {"doc_id": "int64"}, stream="lang", number="number")
    merge_groups(folder)
    return read_shards(spark, folder).groupBy("shard_id").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_sample"))


@query("w9_merged_index", "select doc_id as id, lang as t from documents union all select page_id, url from pages")
def w9(spark, sf_dir):
    """Two folders that were written apart, under one index of the folder above."""
    folder = shared_folder(spark, "merged")
    write_shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("t")), f"{folder}/documents")
    write_shards(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("t")), f"{folder}/pages", compression="")
    merge_index(folder)
    return read_shards(spark, folder).select("id", "t")


@query("k3_compressions", "select c_custkey, c_name, name as compression from customer, (select unnest(['', 'bz2:1', 'gz:5', 'zstd', 'zstd:19']) as name)")
def k3(spark, sf_dir):
    """A table under each compression, and back."""
    out, rows = None, table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for name in ("", "bz2:1", "gz:5", "zstd", "zstd:19"):
        folder = write_shards(rows, shared_folder(spark, "compressed"), size_limit="64kb", compression=name)
        part = read_shards(spark, folder).select("c_custkey", "c_name", F.lit(name).alias("compression"))
        out = part if out is None else out.unionAll(part)
    return out


def _converted(spark, rows, layout: str, **columns: str):
    """Rows in a layout's columns and types, as shards with its encodings, and back."""
    return read_shards(spark, write_shards(as_layout(rows, layout, **columns), shared_folder(spark, layout), LAYOUTS[layout]))


@query("c4_subset_text", "select md5(coalesce(text, '')) as text_md5, coalesce(source, '') as pile_set_name from documents")
def c4(spark, sf_dir):
    return _converted(spark, table(spark, sf_dir, "documents"), "subset_text", pile_set_name="source").select(F.md5("text").alias("text_md5"), "pile_set_name")


@query("c5_segmentation", "select md5(url) as uid_md5, length(html) as x_chars, md5(html) as y_md5 from pages where html is not null and url is not null")
def c5(spark, sf_dir):
    """Images go through as the bytes that they are stored in: here those of pages."""
    rows = table(spark, sf_dir, "pages").where("html is not null and url is not null").select(F.encode("url", "UTF-8").alias("uid"), F.encode("html", "UTF-8").alias("x"), F.encode("html", "UTF-8").alias("y"))
    return _converted(spark, rows, "segmentation").select(F.md5("uid").alias("uid_md5"), F.length(F.decode("x", "UTF-8")).cast("long").alias("x_chars"), F.md5("y").alias("y_md5"))


@query("c8_labelled_images", "select page_id as i, md5(html) as x_md5, length(url) % 10 as y from pages where html is not null")
def c8(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("i"), F.encode("html", "UTF-8").alias("x"), (F.length("url") % 10).alias("y"))
    return _converted(spark, rows, "labelled_image").select("i", F.md5("x").alias("x_md5"), "y")


# Plans of stored streams


def _stored(spark, sf_dir) -> Planner:
    """The documents as four folders of shards by language, planned from their indexes."""
    folder, docs = shared_folder(spark, "streams"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    places = samples_of(docs.select("doc_id", "lang"), "lang", "doc_id", SHARD_ROWS).select(F.col("row_key").alias("doc_id"), "shard_id", "place")
    write_shards(docs.join(places, "doc_id"), folder, {"doc_id": "int64", "n_chars": "int64", "text": "str"}, stream="lang", number="shard_id", order=["place"])
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())  # a row for each stream
    return Planner.of_folders(spark, {n: f"{folder}/{n}" for n in names}, weights=WEIGHTS, world=WORLD, batch_size=4, canonical=2, seed=7, block_size=200)


_STORED_SQL = (
    f"with {SAMPLES}, {draw(EVERY, 1, 7, 1)}, {shuffled('py1e', ALL, 2, 7, 1)}, {grid(ALL, 2, 2, 2, 1, 4)} "
    "select c.node, c.rank, c.worker, c.batch, c.slot, s.sample_id, s.stream_id, d.doc_id, d.n_chars, md5(coalesce(d.text, '')) as text_md5 from cells c join perm using (pos) join drawn using (big_id) "
    "join samples s on s.sample_id = drawn.sample_id join documents d on d.doc_id = s.row_key"
)


@query("e1_gathered_epoch", _STORED_SQL)
def e1_gathered(spark, sf_dir):
    return _stored(spark, sf_dir).gathered(1).select("node", "rank", "worker", "batch", "slot", "sample_id", "stream_id", "doc_id", "n_chars", F.md5("text").alias("text_md5"))


@query("e1_plan_feed", _STORED_SQL)
def e1_feed(spark, sf_dir):
    """The same as a stream, in five batches or so, which goes on after a stop."""
    base, planner = shared_folder(spark, "feed"), _stored(spark, sf_dir)
    plan = write_plan(planner, f"{base}/plan", [1], chunk=4096)
    for _ in range(2):
        rows = plan_feed(spark, plan, max_samples=-(-planner.n // 5), query="feed")
        running = rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").start()
        running.processAllAvailable()
        running.stop()
    return spark.read.parquet(f"{base}/rows").select("node", "rank", "worker", "batch", "slot", "sample_id", "stream_id", "doc_id", "n_chars", F.md5("text").alias("text_md5"))


@query("e5_resume_of_folders", f"with {SAMPLES}, {draw(EVERY, 1, 7, 1)}, {shuffled('py1e', ALL, 2, 7, 1)}, {grid(ALL, 2, 2, 2, 1, 4, 160)} select c.node, c.rank, c.worker, c.batch, c.slot, row_key as doc_id from cells c join perm using (pos) join drawn using (big_id) join samples using (sample_id)")
def e5_stored(spark, sf_dir):
    """A run that stopped after 160 samples, planned anew from the indexes and gathered."""
    return _stored(spark, sf_dir).gathered(1, ["doc_id"], _STOPPED).select("node", "rank", "worker", "batch", "slot", "doc_id")


@query("e8_streamed_shards", "select event_id, user_id, event_type from events")
def e8(spark, sf_dir):
    """A table taken in by several batches. The note of the last batch is lost, so that the batch comes again, and replaces itself."""
    base = shared_folder(spark, "ingested")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").repartition(4).write.parquet(f"{base}/in")
    for again in (False, True):
        if again:
            remove(spark, f"{base}/checkpoint/commits/1")
        rows = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        stream_to_shards(rows, f"{base}/out", "events", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_shards(spark, f"{base}/out").select("event_id", "user_id", "event_type")


@query("r7_by_values", "select doc_id, source from documents where source = 'src3' and n_chars between 100 and 2000 union all select doc_id, source from documents where doc_id in (7, 77, 600)")
def r7_values(spark, sf_dir):
    """Conditions on columns: only shards whose bounds and filters allow for them are opened."""
    folder = shared_folder(spark, "summed")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    write_shards(docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id"), folder, size_limit="4kb", summaries=["doc_id", "source", "n_chars"])
    one = read_shards(spark, folder, columns=["doc_id", "source"], where=[("source", "=", "src3"), ("n_chars", ">=", 100), ("n_chars", "<=", 2000)])
    return one.select("doc_id", "source").unionAll(read_shards(spark, folder, columns=["doc_id", "source"], where=[("doc_id", "in", [7, 77, 600])]).select("doc_id", "source"))


@query("r5_index_to_shards", "select sum(n) as samples, true as all_there from (select count(*) as n from documents)")
def r5(spark, sf_dir):
    folder = shared_folder(spark, "indexed")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang"), folder, size_limit="8kb", compression="gz")
    files, where = filesystem(folder)
    rows = [(s["samples"], files.get_file_info(posixpath.join(where, s["zip_data"]["basename"])).size == s["zip_data"]["bytes"]) for s in read_index(folder)]
    return spark.createDataFrame(rows, "samples long, there boolean").agg(F.sum("samples").alias("samples"), F.bool_and("there").alias("all_there"))


@query("r1_arrays_round_trip", "select vec_id, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total from embeddings")
def r1(spark, sf_dir):
    folder = shared_folder(spark, "arrays")
    write_shards(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), folder)
    return read_shards(spark, folder).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("r7_shard_pruning", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i = 123 or i between 10 and 20")
def r7(spark, sf_dir):
    folder = shared_folder(spark, "pruned")
    # ranges of ids, a task each, whose shards follow each other in the index
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id"), folder, size_limit="64kb")
    return read_shards(spark, folder, columns=["doc_id"], samples=123).unionAll(read_shards(spark, folder, columns=["doc_id"], samples=range(10, 21))).select("doc_id")


@query("r3_json_lines", "select page_id, url, html from pages")
def r3(spark, sf_dir):
    folder = shared_folder(spark, "json")
    write_json_lines(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder, size_limit="1mb", compression="gz")
    return read_by_index(spark, folder).select("page_id", "url", "html")


@query("r4_separated_lines", "select c_custkey, c_name, c_acctbal from customer")
def r4(spark, sf_dir):
    folder = shared_folder(spark, "tsv")
    write_separated(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), folder, "\t", size_limit="64kb")
    return read_by_index(spark, folder).select("c_custkey", "c_name", "c_acctbal")


@query("w4_other_separator", "select s_suppkey, s_name from supplier")
def w4(spark, sf_dir):
    folder = shared_folder(spark, "xsv")
    write_separated(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), folder, "|", hashes="md5")
    return read_by_index(spark, folder).select("s_suppkey", "s_name")


@query("r3_json_access", "select row_number() over (order by page_id) - 1 as sample_id, page_id, url from pages qualify sample_id in (3, 77) or sample_id between 100 and 140")
def r3_access(spark, sf_dir):
    """Rows by position: only their bytes are read."""
    folder = shared_folder(spark, "json")
    write_json_lines(table(spark, sf_dir, "pages").select("page_id", "url").repartitionByRange("page_id").sortWithinPartitions("page_id"), folder, size_limit="4kb")
    return read_by_index(spark, folder, samples=[3, 77, range(100, 141)]).select("sample_id", "page_id", "url")


@query("r4_separated_access", "select c_custkey, c_name from (select *, row_number() over (order by c_custkey) - 1 as i from customer) where i >= 500 and i < 900")
def r4_access(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    write_separated(table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey"), folder, ",", size_limit="8kb", compression="gz")
    return read_by_index(spark, folder, samples=range(500, 900)).select("c_custkey", "c_name")


@query("j7_content_by_path", "select doc_id, md5(text) as content_md5 from documents where length(text) > 0")
def j7(spark, sf_dir):
    """Contents that lie outside of their rows (as videos do), packed by the tasks that have them, found by path."""
    from epochweave.operators.lookup import external_content, pack_contents

    folder, docs = shared_folder(spark, "contents"), table(spark, sf_dir, "documents").where("length(text) > 0")
    docs = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"), F.format_string("%03d/%03d.txt", F.floor(F.col("doc_id") / 1000), F.col("doc_id") % 1000).alias("content_path"))
    places = pack_contents(docs, "content_path", "content", folder)
    return external_content(docs.select("doc_id", "content_path"), "content_path", folder, places).select("doc_id", F.md5("content").alias("content_md5"))


@query("j7_content_in_files", "select page_id, md5(html) as content_md5 from pages where html is not null and page_id % 50 = 0")
def j7_files(spark, sf_dir):
    """One file for each of some rows; the folder isn't listed, and the other files in it aren't opened."""
    from epochweave.operators.lookup import external_content, write_contents

    folder, pages = shared_folder(spark, "files"), table(spark, sf_dir, "pages").where("html is not null")
    pages = pages.select("page_id", F.encode("html", "UTF-8").alias("content"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("content_path"))
    write_contents(pages, "content_path", "content", folder)
    return external_content(pages.where("page_id % 50 = 0").select("page_id", "content_path"), "content_path", folder).select("page_id", F.md5("content").alias("content_md5"))


@query("z1_simulate")
def z1(spark, sf_dir):
    from epochweave.operators.simulate import simulate

    p = _planner(spark, sf_dir, shuffle="py1s")
    plan = p.epoch(1).where("sample_id >= 0").join(p.samples.select("sample_id", "shard_id"), "sample_id")
    return simulate(plan.groupBy("node", "batch", "shard_id").agg(F.min("order").alias("order")).withColumn("size", F.lit(50_000).cast("long")), 0.5, 200_000.0, 300_000, 4)
