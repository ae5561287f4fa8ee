"""Codecs byte for byte, shards and lines there and back."""

import datetime
import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from epochweave.functions.units import bytes_to_int, count_to_int
from epochweave.operators.simulate import Cache
from epochweave.sources.codecs import ARRAY_TYPES, SCALARS, codec, encode
from epochweave.sources.files import compress, decompress, digest, hashes
from epochweave.sources.lines import read_by_index, write_json_lines, write_separated
from epochweave.sources.index import merge_groups, merge_index, read_index, write_index, zipped_indexes
from epochweave.sources.shards import ShardWriter, encodings_of, load_shard, read_shards, shard_columns, type_of, write_shards


@pytest.mark.parametrize("shape", [(7,), (1, 2), (3, 1, 5), (70_000,), (2, 300), (1, 1, 1, 1, 9)])
def test_arrays(shape):
    for dtype in ARRAY_TYPES:
        x = (np.arange(np.prod(shape)) % 100).reshape(shape).astype(dtype)
        for name in ("ndarray", f"ndarray:{dtype}", f"ndarray:{dtype}:{','.join(map(str, shape))}"):
            data = codec(name).encode(x)
            assert (codec(name).decode(data) == x).all() and codec(name).size in (None, len(data))


def test_arrays_that_cannot_be():
    for name, x in (("ndarray", np.zeros(0)), ("ndarray", np.float64(3)), ("ndarray:int8", np.zeros(2)), ("ndarray:float64:3", np.zeros(2)), ("ndarray", np.zeros((1,) * 64))):
        with pytest.raises(ValueError):
            codec(name).encode(x)


def test_scalars_and_others():
    # fixed values: what these numbers are in the format
    assert codec("uint8").encode(42) == b"*" and codec("uint16").encode(42) == b"*\0" and codec("int").encode(-1) == b"\xff" * 8
    for name in SCALARS:
        assert codec(name).decode(codec(name).encode(42)) == 42
    for name, x in (("str", "é"), ("bytes", b"\0a"), ("str_int", 10**40), ("str_float", 0.1), ("str_decimal", Decimal("1.20")), ("json", {"a": [1, None]}), ("list[jpeg]", [b"a", b"", b"bc"]), ("jpeg_array", [b"xyz"]), ("pil", (2, 1, "L", b"ab"))):
        assert codec(name).decode(codec(name).encode(x)) == x
    assert codec("list[png]").encode([b"ab"]) == bytes(4) + b"\1\0\0\0\2\0\0\0ab" and encode("jpeg", b"raw") == b"raw"
    for name, x in (("int8", 200), ("int32", None), ("str", 3), ("float32", None)):
        with pytest.raises((TypeError, ValueError)):
            codec(name).encode(x)
    for name in ("pkl", "nothing"):
        with pytest.raises(ValueError):
            codec(name)


def test_files():
    for name in ("gz", "gz:1", "bz2:9", "zstd", "zstd:22"):
        assert decompress(name, compress(name, b"data" * 99)) == b"data" * 99
    for name in ("lzma", "gz:10", "zstd:0"):
        with pytest.raises(ValueError):
            compress(name, b"")
    assert digest("sha1", b"") == "da39a3ee5e6b4b0d3255bfef95601890afd80709" and {"md5", "xxh64", "sha3_256"} <= hashes().keys()


def test_shards_byte_for_byte(tmp_path):
    out = ShardWriter({"n": "int", "s": "str"}, f"file://{tmp_path}", size_limit=None)
    for i in range(3):
        out.write({"n": i, "s": "x" * i})
    out.flush()
    data = (tmp_path / "shard.00000.mds").read_bytes()
    assert np.frombuffer(data, "<u4", 1)[0] == 3 and np.frombuffer(data, "<u4", 4, 4)[3] == len(data)
    assert json.loads(data[20 : 20 + len(out.head)])["column_names"] == ["n", "s"] and data.endswith(b"\2\0\0\0\2\0\0\0\0\0\0\0xx")
    kinds = {"n": type_of("int"), "s": type_of("str")}
    assert {k: v.to_pylist() for k, v in shard_columns(out.shards[0], data, kinds, 1, 2).items()} == {"n": [1], "s": ["x"]}
    with pytest.raises(IndexError):
        shard_columns(out.shards[0], data, kinds, 0, 4)
    with pytest.raises(ValueError):
        ShardWriter({"n": "int"}, f"file://{tmp_path}", size_limit=1 << 32)


@pytest.mark.parametrize("rows", [5, 7])
def test_shard_sizes(tmp_path, rows):
    """A limit that so many rows fill exactly, or lack a byte to; rows come one by one or in blocks."""
    row = 8 + 4
    for short in (0, 1):
        for block in (1, 23):
            limit = 10**6
            for _ in range(2):  # the limit is part of the head, whose length it changes
                limit = ShardWriter({"n": "int"}, f"file://{tmp_path}/a", limit).empty + rows * row - short
            limit += ShardWriter({"n": "int"}, f"file://{tmp_path}/a", limit).empty + rows * row - short - limit
            out = ShardWriter({"n": "int"}, f"file://{tmp_path}/b{rows}{short}{block}", limit)
            assert limit == out.empty + rows * row - short
            for i in range(0, 23, block):
                out.write_rows(pa.RecordBatch.from_arrays([pa.array(range(i, min(i + block, 23)), pa.int64())], ["n"]))
            out.flush()
            n = rows - short
            assert [s["samples"] for s in out.shards] == [n] * (23 // n) + ([23 % n] if 23 % n else [])
    out = ShardWriter({"s": "str"}, f"file://{tmp_path}/c", 10)
    for text in ("a", "b" * 5000, "c"):
        out.write({"s": text})
    out.flush()
    assert [s["samples"] for s in out.shards] == [1, 1, 1]  # each larger than the limit


def test_data_source(spark, tmp_path):
    rows = [(i, f"text {i}", [i, i + 1], i / 2) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s string, a array<long>, d double").repartition(3)
    folder = f"file://{tmp_path}/out"
    write_shards(df, folder, size_limit="2kb", compression="gz", hashes="md5,sha1")
    back = read_shards(spark, folder, validate="md5")
    assert sorted(tuple(r) for r in back.select("i", "s", "a", "d").collect()) == rows
    ids = [r.sample_id for r in back.collect()]
    assert sorted(ids) == list(range(200)) and len(read_index(folder)) > 5
    one = read_shards(spark, folder, samples=77)
    assert one.first().i == back.where("sample_id = 77").first().i and one.count() == 1 and one.rdd.getNumPartitions() == 1
    assert sorted(r.sample_id for r in back.where("sample_id in (3, 150) or sample_id > 195").collect()) == [3, 150, 196, 197, 198, 199]
    few = read_shards(spark, folder, samples=range(40, 45))
    assert sorted(r.sample_id for r in few.collect()) == list(range(40, 45)) and few.rdd.getNumPartitions() < back.rdd.getNumPartitions()
    assert read_shards(spark, folder, samples=range(500, 600)).count() == 0 and read_shards(spark, folder, columns=["d"]).columns == ["sample_id", "shard_id", "d"]
    with pytest.raises(Exception, match="no nulls"):
        write_shards(spark.createDataFrame([(None,)], "s string"), f"file://{tmp_path}/bad")
    shard = read_index(folder)[0]
    shard["zip_data"]["hashes"]["md5"] = "0"
    with pytest.raises(ValueError):
        load_shard(folder, shard, "md5")


def numbers(spark, folder):
    return sorted(r.n for r in read_shards(spark, folder).collect())


def test_appending_and_replacing(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/out", lambda a, b: spark.range(a, b).withColumnRenamed("id", "n")
    assert write_shards(rows(0, 10), folder) == folder and read_index(folder)[0]["compression"] == "zstd"
    write_shards(rows(10, 15), folder, compression="")
    assert numbers(spark, folder) == list(range(15)) and sorted(r.sample_id for r in read_shards(spark, folder).collect()) == list(range(15))
    with pytest.raises(FileExistsError):
        write_shards(rows(0, 1), folder, mode="error")
    with pytest.raises(Exception, match="no rows"):
        write_shards(rows(0, 0), folder)
    assert numbers(spark, folder) == list(range(15))  # the index is as it was
    before = len(list((tmp_path / "out").rglob("shard.*")))
    write_shards(rows(50, 52), folder, mode="overwrite")
    assert numbers(spark, folder) == [50, 51] and len(list((tmp_path / "out").rglob("shard.*"))) < before


def test_lines_have_an_index(spark, tmp_path):
    rows = [(i, "x" * (i % 7), i / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s string, d double").repartition(2)
    for name, write in (("json", write_json_lines), ("csv", write_separated), ("xsv", lambda d, f, **o: write_separated(d, f, "|", **o))):
        for compression in ("", "gz"):
            folder = f"file://{tmp_path}/{name}{compression}"
            write(df, folder, size_limit="2kb", compression=compression)
            shards = read_index(folder)
            assert len(shards) > 3 and {s["format"] for s in shards} == {name} and sum(s["samples"] for s in shards) == 300
            assert sorted(tuple(r) for r in read_by_index(spark, folder).select("i", "s", "d").collect()) == rows
            one = shards[0]
            data, meta = (load_shard(folder, one | {"raw_data": one[f"raw_{k}"], "zip_data": one[f"zip_{k}"]}) for k in ("data", "meta"))
            n, offsets = np.frombuffer(meta, "<u4", 1)[0], np.frombuffer(meta, "<u4", one["samples"] + 1, 4)
            assert n == one["samples"] and offsets[-1] == len(data) and all(data[b - 1 : b] == b"\n" for b in offsets[1:].tolist())
            assert offsets[0] == (0 if name == "json" else data.index(b"\n") + 1)
    with pytest.raises(Exception, match="separator"):
        write_separated(spark.createDataFrame([("a,b",)], "s string"), f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="null"):
        write_json_lines(spark.createDataFrame([(None,)], "s string"), f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        write_json_lines(df, f"file://{tmp_path}/bad", compression="zstd")


def test_groups_get_running_numbers(spark, tmp_path):
    folder = f"file://{tmp_path}/groups"
    for part, n in (("b", 3), ("a", 5)):
        write_shards(spark.range(n).selectExpr(f"concat('{part}', id) as s").coalesce(1), f"{folder}/{part}", size_limit="none")
    names = [s["zip_data"]["basename"] for s in merge_groups(folder)]
    assert names == ["shard.00000.mds.zstd", "shard.00001.mds.zstd"] and all((tmp_path / "groups" / n).is_file() for n in names)
    assert [r.s for r in read_shards(spark, folder).orderBy("sample_id").collect()] == ["a0", "a1", "a2", "a3", "a4", "b0", "b1", "b2"]
    assert zipped_indexes(["x"], ["y"]) == [("x", "y")]
    with pytest.raises(ValueError):
        zipped_indexes(["x"], [])


def test_every_kind_of_column_there_and_back(spark, tmp_path):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=datetime.UTC)
    kinds = "a tinyint, b smallint, c int, d bigint, e float, f double, g decimal(10,2), h string, i binary, j array<int>, k struct<x:int,y:array<string>>, l map<string,int>, m timestamp, n date, o boolean"
    row = (-1, 2, -3, 1 << 60, 0.5, 0.1, Decimal("1.20"), "é\0", b"\xff", [1, -2], (7, ["z"]), {"q": 1}, when, when.date(), True)
    folder = write_shards(spark.createDataFrame([row, row], kinds), f"file://{tmp_path}/kinds")
    got = read_shards(spark, folder).drop("sample_id", "shard_id").first()
    assert got[:10] == (-1, 2, -3, 1 << 60, 0.5, 0.1, "1.20", "é\0", b"\xff", [1, -2])
    assert json.loads(got.k) == {"x": 7, "y": ["z"]} and json.loads(got.l) == {"q": 1} and got.m == round(when.timestamp() * 10**6) and got.n == 19849 and got.o == 1
    with pytest.raises(Exception, match="no uint8"):
        write_shards(spark.createDataFrame([(300,)], "a int"), f"file://{tmp_path}/bad", {"a": "uint8"})


def test_unsafe_columns_are_refused(spark, tmp_path):
    folder = write_shards(spark.range(3), f"file://{tmp_path}/unsafe")
    index = read_index(folder)
    write_index(folder, [s | {"column_encodings": ["pkl"]} for s in index])
    with pytest.raises(Exception, match="unsafe"):
        read_shards(spark, folder)


def test_folders_are_named_in_full(spark, tmp_path):
    from epochweave.places import filesystem, qualified, shared_folder

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and qualified(spark, "s3a://b/x/") == "s3a://b/x"
    for bad in ("/bare/path", "wasbs://b/x", "dbfs://x"):
        with pytest.raises(ValueError):
            filesystem(bad)
    assert filesystem(f"file://{tmp_path}")[1] == str(tmp_path)
    assert shared_folder(spark, "x").startswith("file:///") and spark.sparkContext.applicationId in shared_folder(spark, "x")
    folder = write_shards(spark.range(3), f"{tmp_path}/bare")
    assert folder == f"file://{tmp_path}/bare" and read_shards(spark, f"{tmp_path}/bare").count() == 3


def test_merged_indexes(tmp_path):
    for part in ("a", "b"):
        out = ShardWriter({"n": "int"}, f"file://{tmp_path}/{part}")
        out.write({"n": 1})
        out.flush()
        write_index(f"file://{tmp_path}/{part}", out.shards)
    assert merge_index(f"file://{tmp_path}") == 2 and merge_index(f"file://{tmp_path}", ["a", "a"]) == 1 and merge_index(f"file://{tmp_path}", []) == 0


def test_types(spark):
    kinds = "a tinyint, b smallint, c int, d bigint, e float, f double, g decimal(10,2), h string, i binary, j array<int>, k struct<x:int>, t timestamp"
    schema = spark.createDataFrame([], kinds).schema
    assert list(encodings_of(schema).values()) == ["int8", "int16", "int32", "int64", "float32", "float64", "str_decimal", "str", "bytes", "ndarray:int32", "json", "int64"]
    assert encodings_of(schema, unsigned=True)["a"] == "uint8"


def test_units():
    assert bytes_to_int("1.5kb") == 1536 and bytes_to_int("7") == 7 and bytes_to_int("2GB") == 2 << 30 and count_to_int("1.5k") == 1500 and count_to_int("2b") == 2 * 10**9
    for text in ("kb", "1xb", "-1kb"):
        with pytest.raises(ValueError):
            bytes_to_int(text)


def test_cache_lets_the_oldest_go():
    c = Cache(100)
    assert [c.use(1, 50), c.use(2, 50), c.use(1, 50), c.use(3, 50), c.use(1, 50), c.use(2, 50)] == [50, 50, 0, 50, 0, 50]


def test_arrays_as_bytes(spark):
    from epochweave.functions.binary import KINDS, pack, unpack

    for dtype in KINDS:
        df = spark.createDataFrame([([1, 2, 300],), ([],), (None,)], "v array<int>").select(pack("v", dtype).alias("b"))
        assert [r.v for r in df.select(unpack("b", dtype).alias("v")).collect()] == [[1, 2, 300], [], None]
    assert bytes(spark.createDataFrame([([1],)], "v array<int>").select(pack("v", "int32").alias("b")).first().b) == b"\1\0\0\0"


def test_columns_of_arrays_are_their_values_bytes(monkeypatch):
    """Whole columns beside the codec of each value; no value of ordinary arrays is handled by itself."""
    from epochweave.sources import columns as C
    from epochweave.sources.codecs import codec

    doubles, whole = pa.list_(pa.float64()), pa.list_(pa.int64())
    cases = [
        ("ndarray:float32", pa.array([[1.5], [float("nan"), 2.0] * 200, [3.0] * 70000], doubles)),
        ("ndarray:float32", pa.array([[[0.0] * 2] * 3, [[1.0, 2.0, 3.0, 4.0]], [[5.0] * 300]], pa.list_(doubles)).slice(1)),
        ("ndarray:int64", pa.array([[9], [1, 2], [-(1 << 62)]], whole).slice(1)),
        ("ndarray:uint8", pa.array([[0, 255]], whole)),
    ]
    want = [[codec(e).encode(x) for x in c.to_pylist()] for e, c in cases]
    monkeypatch.setattr(C, "encode", None)
    for (e, c), parts in zip(cases, want, strict=True):
        data, lengths = C.column_bytes(c, e)
        assert (data.tobytes(), lengths.tolist()) == (b"".join(parts), [*map(len, parts)])
        starts = np.cumsum(lengths + 4) - lengths - 4
        rows = np.frombuffer(b"".join(len(p).to_bytes(4, "little") + p for p in parts), np.uint8)
        monkeypatch.setattr(C, "_read_as", None)
        kind = T.ArrayType(T.LongType() if "int" in e else T.DoubleType())
        flat = lambda x: [v for y in x for v in (y if isinstance(y, list) else [y])]
        assert str(C.decode_rows(rows, starts, {"x": e}, {"x": kind})["x"].to_pylist()) == str([flat(x) for x in c.to_pylist()])
    monkeypatch.undo()
    for e, bad in (("ndarray:uint8", [[256]]), ("ndarray:int64", [[]]), ("ndarray:float32", [[1.0], []])):
        with pytest.raises((ValueError, OverflowError)):
            C.column_bytes(pa.array(bad), e)
    cut = np.frombuffer(b"\x09\x00\x00\x00" + codec("ndarray:float32").encode([1.0, 2.0])[:9], np.uint8)
    with pytest.raises(ValueError):
        C.decode_rows(cut, np.array([0]), {"x": "ndarray:float32"}, {"x": T.ArrayType(T.FloatType())})
    assert C.column_bytes(pa.array([[1.0, None]]), "ndarray:float32")[0].tobytes() == codec("ndarray:float32").encode([1.0, None])


def test_a_shard_is_held_about_twice_while_it_is_written(tmp_path):
    """Its blocks and its bytes, and no index of single bytes beside them; both ways of copying values give the same rows."""
    import tracemalloc

    from epochweave.sources import columns as C

    folder = f"file://{tmp_path}/one"
    batch = pa.record_batch({"text": pa.array([str(i % 10) * 2000 for i in range(16_000)]), "n": pa.array(range(16_000))})
    out = ShardWriter({"text": "str", "n": "int64"}, folder, compression="zstd")
    tracemalloc.start()
    out.write_rows(batch)
    out.flush()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out.shards) == 1 and peak < 2.6 * out.shards[0]["raw_data"]["bytes"]
    rows = shard_columns(out.shards[0], load_shard(folder, out.shards[0]), {"text": T.StringType(), "n": T.LongType()})
    assert rows["text"].equals(batch.column("text")) and rows["n"].equals(batch.column("n"))
    mixed = [pa.array(["", "x" * 5000, "é", "y" * 300])]
    long = C.encode_rows(mixed, ["str"])[0].tobytes()
    C.LONG, before = 1 << 40, C.LONG
    try:
        assert C.encode_rows(mixed, ["str"])[0].tobytes() == long
    finally:
        C.LONG = before
