"""Queries over converters: tables in the columns that training expects, written as shards and read back."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F

from epochweave.functions.binary import pack, unpack
from epochweave.operators.convert import LAYOUTS, as_layout, images_with_boxes, transformed, write_converted
from epochweave.places import shared_folder
from epochweave.registry import query, table
from epochweave.sources.registry import build
from epochweave.sources.shards import read_shards, write_shards


def _stored(spark, rows, layout: str, **columns: str):
    """Rows in a layout's columns and types, as shards with its encodings, and back."""
    return read_shards(spark, write_shards(as_layout(rows, layout, **columns), shared_folder(spark, layout), LAYOUTS[layout]))


@query("c2_plain_text", "select md5(coalesce(text, '')) as text_md5, length(coalesce(text, '')) as n_chars from conversations")
def c2(spark, sf_dir):
    return _stored(spark, table(spark, sf_dir, "conversations"), "plain_text").select(F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("c6_raw_images", "select page_id as i, strlen(html) as width, 1 as height, 'L' as mode, md5(html) as data_md5, length(url) % 10 as y from pages where html is not null and url is not null")
def c6(spark, sf_dir):
    """Grey images of one line: the bytes of pages."""
    data = F.encode("html", "UTF-8")
    image = F.struct(F.octet_length(data).alias("width"), F.lit(1).alias("height"), F.lit("L").alias("mode"), data.alias("data"))
    rows = table(spark, sf_dir, "pages").where("html is not null and url is not null").select(F.col("page_id").alias("i"), image.alias("x"), (F.length("url") % 10).alias("y"))
    return _stored(spark, rows, "raw_image").select("i", F.col("x.width").cast("long").alias("width"), F.col("x.height").cast("long").alias("height"), "x.mode", F.md5("x.data").alias("data_md5"), "y")


@query(
    "c7_boxed_images",
    "with b as (select o_orderkey as img_id, l_partkey % 64 as x, l_suppkey % 64 as y, l_linenumber as w, l_linenumber * 2 as h, ascii(l_returnflag) as class_id from lineitem join orders on o_orderkey = l_orderkey) "
    "select img_id, md5(o_orderpriority) as img_md5, n_boxes, x0, y0, x1, y1, labels from (select img_id, count(*) as n_boxes, sum(x / 64.0) as x0, sum(y / 128.0) as y0, sum((x + w) / 64.0) as x1, sum((y + h) / 128.0) as y1, "
    "string_agg(class_id::varchar, ',' order by x, y, w, h, class_id) as labels from b group by img_id) join orders on o_orderkey = img_id",
)
def c7(spark, sf_dir):
    """Orders as images of 64 x 128, their lines as boxes. Corners are whole parts of the sides, so that sums of float32 are exact."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("img_id"), F.encode("o_orderpriority", "UTF-8").alias("img"), F.lit(128).alias("htot"), F.lit(64).alias("wtot"))
    lines = table(spark, sf_dir, "lineitem")
    at = {"left": F.col("l_partkey") % 64, "top": F.col("l_suppkey") % 64, "width": F.col("l_linenumber"), "height": F.col("l_linenumber") * 2}
    boxes = lines.select(F.col("l_orderkey").alias("img_id"), F.col("l_returnflag").alias("class_name"), *[c.cast("double").alias(n) for n, c in at.items()])
    classes = lines.select(F.col("l_returnflag").alias("class_name")).distinct().withColumn("class_id", F.ascii("class_name"))
    out = _stored(spark, images_with_boxes(images, boxes, classes), "boxed_image")
    corner = lambda k: F.aggregate(F.filter("bbox_sizes", lambda x, i: i % 4 == k), F.lit(0.0), lambda s, x: s + x.cast("double"))  # noqa: E731  boxes come as one flat array
    labels = F.array_join(F.col("bbox_labels").cast("array<string>"), ",").alias("labels")
    return out.select("img_id", F.md5("img").alias("img_md5"), F.size("bbox_labels").cast("long").alias("n_boxes"), *[corner(k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], labels)


@query("c11_transforms", "select page_id as i, upper(left(url, 12)) as x, page_id * 2 + 1 as y from pages where url is not null")
def c11(spark, sf_dir):
    """Functions of whole series, as a loader has them for x and y, over stored rows."""
    rows = table(spark, sf_dir, "pages").where("url is not null").select(F.col("page_id").alias("i"), F.col("url").alias("x"), F.col("page_id").alias("y"))
    stored = read_shards(spark, write_shards(rows, shared_folder(spark, "transformed"))).select("i", "x", "y")
    return transformed(stored, "i long, x string, y long", x=lambda s: s.str.slice(0, 12).str.upper(), y=lambda s: s * 2 + 1)


def _lines_of(batch: pd.DataFrame) -> Iterable[dict]:
    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        for place, line in enumerate([] if text is None else text.split("\n")):
            yield {"doc_id": doc_id, "place": place, "line": line}


@query("q1_generated_rows", "select doc_id, place, md5(line) as line_md5 from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from documents)")
def q1(spark, sf_dir):
    """Shards of the rows that a user's generator makes of each batch: here the lines of documents."""
    folder = shared_folder(spark, "generated")
    write_converted(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, {"doc_id": "int64", "place": "int64", "line": "str"}, _lines_of, "doc_id long, place long, line string", size_limit="1mb")
    return read_shards(spark, folder).select("doc_id", "place", F.md5("line").alias("line_md5"))


@query("q3_named_source", "select p_partkey, p_name, p_size from part")
def q3(spark, sf_dir):
    """A stream by the name of its source."""
    folder = write_shards(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size")), shared_folder(spark, "named"), size_limit="64kb")
    return build("stream", spark, path=folder).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("f14_arrays_as_bytes", "select vec_id, 4 * len(embedding) as n_bytes, 8 * len(embedding) as n_wide, list_sum(list_transform(embedding, lambda x: cast(round(cast(x as double) * 1000) as bigint))) as total from embeddings where embedding is not null")
def f14(spark, sf_dir):
    """Vectors as little-endian bytes and back: as floats, and as whole thousandths."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", pack(F.col("embedding"), "float32").alias("narrow"))
    whole = F.transform(unpack(F.col("narrow"), "float32"), lambda x: F.round(x.cast("double") * 1000).cast("long"))
    rows = rows.select("vec_id", F.octet_length("narrow").cast("long").alias("n_bytes"), pack(whole, "int64").alias("wide"))
    return rows.select("vec_id", "n_bytes", F.octet_length("wide").cast("long").alias("n_wide"), F.aggregate(unpack(F.col("wide"), "int64"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
