"""Files of any store that tasks and the driver both see: found by path, folder or glob, written in stages and committed at once."""

from __future__ import annotations

import contextlib
import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession

#: The list of what a folder holds that was written in stages.
MANIFEST = "_manifest"
#: Used only where the session names no shared folder and there is one machine.
FALLBACK_SHARED = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that spark.checkpoint.dir names, which driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(found or FALLBACK_SHARED).rstrip('/')}/docframe-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path, re.I):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)/?", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _inside(store: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """Files below a folder, but for hidden ones and what is being written."""
    for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if not info.base_name.startswith(("_", ".")):
            if info.type == fs.FileType.Directory:
                yield from _inside(store, info.path)
            else:
                yield info


def find(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """(path, bytes) of a file, of the files of a folder or of a glob. Where a folder has a manifest, that says which."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return store, [(place, info.size)]
    if info.type == fs.FileType.Directory:
        listed = manifest(store, place)
        if listed is not None:
            return store, [(f"{place}/{f['name']}", f["bytes"]) for f in listed]
        return store, [(i.path, i.size) for i in _inside(store, place)]
    wild = re.search(r"[*?\[]", place)
    base = place[: wild.start()].rpartition("/")[0] if wild else place
    if not wild or store.get_file_info(base or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    depth = place.count("/")
    return store, [(i.path, i.size) for i in _inside(store, base or "/") if i.path.count("/") == depth and fnmatch.fnmatchcase(i.path, place)]


def manifest(store: fs.FileSystem, folder: str) -> list[dict] | None:
    """[{name, bytes, ...}] of a folder's committed files; None if it has no manifest."""
    if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def listing(folder: str) -> list[dict]:
    """What the manifest of a folder says of committed files and of the last write's failed ones."""
    store, place = opened(folder)
    with store.open_input_stream(f"{place}/{MANIFEST}") as f:
        found = json.loads(f.read())
    return found["files"] + found["failed"]


class Staged:
    """A write in stages: tasks put files aside, and commit() shows all of them at once, or abort() none.

    A task that fails or runs twice leaves nothing that counts, as only what its message names is moved. What is there is
    looked at once, in commit(), before anything is moved. The manifest comes last, and readers go by it, so a commit that
    breaks off shows nothing.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, place = opened(self.folder)
        return store, place, f"{place}/_temporary/{self.job}"

    def put(self, task: str, name: str, data: bytes) -> None:
        store, _, aside = self._places()
        if name.startswith(("/", "_", ".")) or ".." in name.split("/"):
            raise ValueError(f"{name}: no name for an output")
        place = f"{aside}/{task}/{name}"
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as f:
            f.write(data)

    def commit(self, files: list[tuple[str, dict]], overwrite: bool, append: bool) -> None:
        """Moves files (task, {name, bytes, ...}) to their names; those without bytes are listed as failed.

        A name that is there is an error, and nothing changes, unless overwrite is set. Files that the manifest names and
        this write does not stay with append, and go without; without append and overwrite, any such file is an error.
        """
        store, place, aside = self._places()
        store.create_dir(place, recursive=True)
        failed, files = [f for _, f in files if f["bytes"] is None], [(t, f) for t, f in files if f["bytes"] is not None]
        names = [f["name"] for _, f in files]
        before = manifest(store, place) or []
        if before and not overwrite and not append:
            raise FileExistsError(f"{place} holds files")
        there = {i.path for i in store.get_file_info([f"{place}/{n}" for n in names]) if i.type != fs.FileType.NotFound} if names else set()
        if len(set(names)) < len(names):
            raise FileExistsError(f"several rows are written to {min(n for n in names if names.count(n) > 1)}")
        if there and not overwrite:
            raise FileExistsError(f"{min(there)} exists")
        for task, f in files:
            to = f"{place}/{f['name']}"
            store.create_dir(to.rpartition("/")[0], recursive=True)
            if to in there:
                store.delete_file(to)
            store.move(f"{aside}/{task}/{f['name']}", to)
        old = [f for f in before if f["name"] not in set(names)]
        listed = [f for _, f in files] if overwrite and not append else old + [f for _, f in files]
        with store.open_output_stream(f"{aside}.json") as f:
            f.write(json.dumps({"files": sorted(listed, key=lambda f: f["name"]), "failed": failed}, ensure_ascii=False).encode())
        if store.get_file_info(f"{place}/{MANIFEST}").type == fs.FileType.File:
            store.delete_file(f"{place}/{MANIFEST}")
        store.move(f"{aside}.json", f"{place}/{MANIFEST}")
        if overwrite and not append:
            for f in old:
                if store.get_file_info(f"{place}/{f['name']}").type == fs.FileType.File:
                    store.delete_file(f"{place}/{f['name']}")
        self.abort()

    def abort(self) -> None:
        """Removes what was put aside. Tasks that still run may put more aside, which stays hidden and counts for nothing."""
        store, place, aside = self._places()
        for folder in (aside, f"{place}/_temporary"):
            with contextlib.suppress(OSError):
                if folder == aside or not store.get_file_info(fs.FileSelector(folder)):
                    store.delete_dir(folder)
