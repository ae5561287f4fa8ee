"""Rows of well-known data sets in the columns that training expects, ready to be written as shards."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.sources.shards import write_shards

#: The encodings of each kind of row.
LAYOUTS = {
    "web_text": {"text": "str", "timestamp": "str", "url": "str"},
    "subset_text": {"text": "str", "pile_set_name": "str"},
    "plain_text": {"text": "str"},
    "labelled_image": {"i": "int", "x": "jpeg", "y": "int"},
    "raw_image": {"i": "int", "x": "pil", "y": "int"},
    "segmentation": {"uid": "bytes", "x": "jpeg", "y": "png"},
    "boxed_image": {"img": "jpeg", "img_id": "int", "htot": "int", "wtot": "int", "bbox_sizes": "ndarray:float32", "bbox_labels": "ndarray:int64"},
    "video": {"videoid": "str", "name": "str", "page_idx": "str", "page_dir": "str", "duration": "int", "contentUrl": "str", "content": "bytes"},
    "video_outside": {"videoid": "str", "name": "str", "page_idx": "str", "page_dir": "str", "duration": "int", "contentUrl": "str", "content_path": "str"},
    "captioned_image": {
        "nsfw": "str", "similarity": "float64", "license": "str", "caption": "str", "url": "str", "key": "str", "status": "str", "error_message": "str",
        "width": "int32", "height": "int32", "original_width": "int32", "original_height": "int32", "exif": "str", "jpg": "bytes",
    },
    "segment_pair": {n: "bytes" for n in ("input_ids", "input_mask", "segment_ids", "masked_lm_positions", "masked_lm_ids", "masked_lm_weights", "next_sentence_labels")},
}
#: The Spark type of each encoding that occurs above, where it is to be cast, and what a null becomes.
CASTS = {"str": ("string", ""), "int": ("bigint", 0), "int32": ("int", 0), "float64": ("double", None), "bytes": ("binary", b""), "jpeg": ("binary", None), "png": ("binary", None)}


def as_layout(rows: DataFrame, layout: str, **columns: str) -> DataFrame:
    """rows with exactly the layout's columns, cast to its types; columns says which of them is which, where names differ.

    Null texts and bytes become empty, null and NaN whole numbers 0; a float stays as it is, and an image must be there.
    """
    out = []
    for name, encoding in LAYOUTS[layout].items():
        c = F.col(columns.get(name, name))
        if encoding in CASTS:
            kind, default = CASTS[encoding]
            if encoding in ("int", "int32") and dict(rows.dtypes)[columns.get(name, name)] in ("double", "float"):
                c = F.nanvl(c, F.lit(0))
            c = c.cast(kind)
            c = c if default is None else F.coalesce(c, F.lit(default))
        out.append(c.alias(name))
    return rows.select(*out)


def transformed(rows: DataFrame, schema: str, **transforms: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """rows with columns changed by functions of whole series (as a loader's transforms of x and y are), in batches; schema is that of the result."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{n: f(batch[n]) for n, f in transforms.items()})

    return rows.mapInPandas(run, schema)


def images_with_boxes(images: DataFrame, boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Images (img_id, img, htot, wtot) with their boxes (img_id, class_name, left, top, width, height) as corners from 0 to 1 and class numbers.

    Images without boxes are left out; an image id that comes twice is an error.
    """
    known = images.groupBy("img_id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("img", "htot", "wtot")])
    known = known.withColumn("img_id", F.when(F.col("_n") == 1, F.col("img_id")).otherwise(F.raise_error("an image id comes twice"))).drop("_n")
    found = boxes.join(classes, "class_name").groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct("left", "top", "width", "height", "class_id"))).alias("b"))  # an image's own boxes
    corners = F.transform("b", lambda x: F.array(x["left"] / F.col("wtot"), x["top"] / F.col("htot"), (x["left"] + x["width"]) / F.col("wtot"), (x["top"] + x["height"]) / F.col("htot")))
    return known.join(found, "img_id").select("img_id", "img", "htot", "wtot", corners.alias("bbox_sizes"), F.transform("b", lambda x: x["class_id"]).alias("bbox_labels"))


def write_converted(df: DataFrame, folder: str, columns: dict[str, str], rows_of: Callable[[pd.DataFrame], Iterable[dict]], schema: str, **options: str) -> None:
    """Shards of the rows that rows_of makes of each batch of df."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(list(rows_of(batch)), columns=list(columns))

    write_shards(df.mapInPandas(run, schema), folder, columns, **options)
