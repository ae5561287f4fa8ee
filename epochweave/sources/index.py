"""The index of a folder of shards: a log of commits, each put where nothing is yet, and index.json, which is the log folded.

A commit adds shards, takes all shards away first (overwrite), or stands for one batch of one stream, whose shards replace those of an
earlier commit of the same batch. Writers that commit at the same time get different places in the log, so that none loses another's
shards. index.json names the last commit it holds; readers fold what the log has beyond it, and programs that know only index.json see
the folder as of then.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid

from pyarrow import fs

from epochweave.places import filesystem

VERSION, INDEX, LOG = 2, "index.json", "_commits"
FILES = ("raw_data", "raw_meta", "zip_data", "zip_meta")
#: How often a commit looks for a free place.
TRIES = 1000


def put_if_absent(files: fs.FileSystem, path: str, data: bytes) -> bool:
    """Whether the file is now there with this data; False if it was there before.

    A link (local) or a rename that never replaces (HDFS) decides between writers. Stores without either only get a look beforehand,
    so that writers to one folder of theirs must follow each other.
    """
    fresh = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}")
    with files.open_output_stream(fresh, compression=None) as out:
        out.write(data)
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(fresh, path)
            return True
        if files.get_file_info(path).type != fs.FileType.NotFound:
            return False
        files.move(fresh, path)
        return True
    except OSError:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            raise
        return False
    finally:
        if files.get_file_info(fresh).type != fs.FileType.NotFound:
            files.delete_file(fresh)


def _json(files: fs.FileSystem, path: str) -> dict:
    with files.open_input_stream(path, compression=None) as stream:
        return json.loads(stream.read())


def folded(shards: list[dict], commit: dict) -> list[dict]:
    """The shards after a commit."""
    batch = commit.get("batch")
    left = [] if commit.get("overwrite") else [s for s in shards if batch is None or s.get("batch") != batch]
    return left + [s | {"batch": batch} if batch is not None else s for s in commit["shards"]]


def _commits(folder: str) -> list[int]:
    files, where = filesystem(folder)
    listed = files.get_file_info(fs.FileSelector(posixpath.join(where, LOG), allow_not_found=True))
    return sorted(int(f.base_name.partition(".")[0]) for f in listed if f.base_name.endswith(".json") and f.base_name[0] != ".")


def _read(folder: str) -> tuple[list[dict], int]:
    """The shards, and the number of the last commit (-1 for none)."""
    files, where = filesystem(folder)
    shards, last, found = [], -1, False
    if files.get_file_info(posixpath.join(where, INDEX)).is_file:
        index, found = _json(files, posixpath.join(where, INDEX)), True
        if index["version"] != VERSION:
            raise ValueError(f"version {index['version']} of an index")
        shards, last = index["shards"], index.get("commit", -1)
    for number in _commits(folder):
        if number > last:
            shards, last, found = folded(shards, _json(files, posixpath.join(where, LOG, f"{number:020}.json"))), number, True
    if not found:
        raise FileNotFoundError(f"{folder} has no index")
    return shards, last


def read_index(folder: str) -> list[dict]:
    return _read(folder)[0]


def has_index(folder: str) -> bool:
    try:
        _read(folder)
    except FileNotFoundError:
        return False
    return True


def write_index(folder: str, shards: list[dict], commit: int | None = None) -> None:
    """index.json alone, in place of all commits so far if it isn't said which one it is as of.

    It's written under another name first, so that readers see the old one or the new one.
    """
    files, where = filesystem(folder)
    files.create_dir(where, recursive=True)
    commit = max(_commits(folder), default=None) if commit is None else commit
    fresh, path = posixpath.join(where, f".{INDEX}.{uuid.uuid4().hex}"), posixpath.join(where, INDEX)
    with files.open_output_stream(fresh, compression=None) as out:
        out.write(json.dumps({"version": VERSION, "shards": shards} | ({} if commit is None else {"commit": commit}), sort_keys=True).encode())
    try:
        files.move(fresh, path)
    except OSError:  # HDFS doesn't replace: the log holds what readers need meanwhile
        files.delete_file(path)
        files.move(fresh, path)


def commit(folder: str, shards: list[dict], overwrite: bool = False, batch: str | None = None) -> list[dict]:
    """Put a commit in the log and renew index.json; the shards that it took away."""
    files, where = filesystem(folder)
    files.create_dir(posixpath.join(where, LOG), recursive=True)
    data = json.dumps({"shards": shards, "overwrite": overwrite, "batch": batch}, sort_keys=True).encode()
    for _ in range(TRIES):
        before, last = _read(folder) if has_index(folder) else ([], -1)
        if put_if_absent(files, posixpath.join(where, LOG, f"{last + 1:020}.json"), data):
            break
    else:
        raise OSError(f"no place for a commit in {folder} after {TRIES} tries")
    after, number = _read(folder)
    while True:
        write_index(folder, after, number)
        newer, now = _read(folder)  # another writer may have written an older one over it, or have gone on
        if now == number and _json(files, posixpath.join(where, INDEX)).get("commit") == number:
            break
        after, number = newer, now
    return before if overwrite else [s for s in before if batch is not None and s.get("batch") == batch]


def moved(shard: dict, name) -> dict:
    """A shard whose files have other names."""
    return shard | {k: shard[k] | {"basename": name(shard[k]["basename"])} for k in FILES if shard.get(k)}


def delete_files(folder: str, shards: list[dict]) -> None:
    """What the shards are stored in, as far as it is there."""
    files, where = filesystem(folder)
    for name in {s[k]["basename"] for s in shards for k in FILES if s.get(k)}:
        if files.get_file_info(path := posixpath.join(where, name)).is_file:
            files.delete_file(path)


def parts_below(folder: str) -> list[str]:
    files, where = filesystem(folder)
    found = files.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(posixpath.relpath(posixpath.dirname(f.path), where) for f in found if posixpath.basename(f.path) == INDEX)


def merge_index(folder: str, parts: list[str] | None = None) -> int:
    """One index over the indexes of folders below this one (those named, each once, or all that have one); how many shards it has."""
    shards = []
    for part in dict.fromkeys(p for p in (parts_below(folder) if parts is None else parts) if p != "."):
        shards += [moved(s, lambda name: f"{part}/{name}") for s in read_index(f"{folder}/{part}")]  # noqa: B023
    if shards:
        commit(folder, shards, overwrite=True)
    return len(shards)


def merge_groups(folder: str) -> list[dict]:
    """The shards of all folders below this one in this one, under running numbers in order of folder and shard; the new index's shards."""
    files, where = filesystem(folder)
    shards, number = [], 0
    for part in [p for p in parts_below(folder) if p != "."]:
        for shard in read_index(f"{folder}/{part}"):
            new = moved(shard, lambda name: ".".join([*name.split("/")[-1].split(".")[:1], f"{number:05}", *name.split("/")[-1].split(".")[2:]]))  # noqa: B023
            for k in FILES:
                if shard.get(k) and not (k.startswith("raw") and shard.get(k.replace("raw", "zip"))):
                    files.move(posixpath.join(where, part, shard[k]["basename"]), posixpath.join(where, new[k]["basename"]))
            shards.append(new)
            number += 1
        files.delete_file(posixpath.join(where, part, INDEX))
        if files.get_file_info(log := posixpath.join(where, part, LOG)).type == fs.FileType.Directory:
            files.delete_dir(log)
    commit(folder, shards, overwrite=True)
    return shards


def zipped_indexes(here: list[str], there: list[str]) -> list[tuple[str, str]]:
    """Pairs of local and remote indexes by place; lists of different lengths can't be told apart, and are an error."""
    if len(here) != len(there):
        raise ValueError("there must be as many local as remote indexes")
    return list(zip(here, there, strict=True))
