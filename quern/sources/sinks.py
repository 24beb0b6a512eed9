"""Sinks: JSON lines, atomic JSON, treebank text, event logs, manifests, publication."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import file_hash, fingerprint_value


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object for each row; a directory that holds anything is an error. Infinite numbers
    and NaN are refused: the row fails the write."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    for c in floats:
        bad = F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is no finite number")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_json(path: str, value) -> None:
    """Atomic: a temporary file beside the target, then a rename."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def write_conllu(df: DataFrame, path: str, order: list[str]) -> None:
    """Sentences as treebank text, in order over the part files."""
    one = F.concat(F.array_join("lines", "\n"), F.lit("\n"))  # the writer adds the line feed of the blank line
    df.orderBy(*order).select(one.alias("value")).write.mode("errorifexists").text(path)


def fresh(path: str) -> str:
    """The path, if it is absent or an empty directory."""
    if os.path.exists(path) and (not os.path.isdir(path) or os.listdir(path)):
        raise FileExistsError(f"{path} is not empty")
    return path


class EventLog:
    """Append-only JSON lines of ``time, event`` and further fields."""

    def __init__(self, path: str):
        self.path = path

    def event(self, name: str, **fields) -> None:
        row = {"time": datetime.now(timezone.utc).isoformat(), "event": name, **fields}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, ensure_ascii=False, allow_nan=False) + "\n")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_manifest(folder: str, files: list[str], **recipe) -> dict:
    """A manifest with the hash of every file and a fingerprint over it (time stamps left out)."""
    body = {"files": {f: file_hash(os.path.join(folder, f)) for f in sorted(files)}, **recipe}
    manifest = {**body, "fingerprint": fingerprint_value(body), "created_at": datetime.now(timezone.utc).isoformat()}
    write_json(os.path.join(folder, "manifest.json"), manifest)
    return manifest


def load_verified(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A JSON-lines file of a folder after every hash and the fingerprint of its manifest agree."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    body = {k: v for k, v in manifest.items() if k not in ("fingerprint", "created_at")}
    if fingerprint_value(body) != manifest["fingerprint"]:
        raise ValueError("the manifest's fingerprint differs")
    for f, digest in manifest["files"].items():
        if file_hash(os.path.join(folder, f)) != digest:
            raise ValueError(f"{f} differs from the manifest")
    return spark.read.schema(schema).json(os.path.join(folder, name))


def publish(sources: dict[str, str], target: str, recorded: dict[str, str] | None = None) -> dict[str, str]:
    """Copy files into an empty folder and check each copy's hash; returns the hashes.

    ``recorded`` are the hashes that the files' own manifest names: a file that has changed since,
    or that changes while it is copied, is an error, and then nothing is left in the folder.
    """
    fresh(target)
    hashes = {name: file_hash(path) for name, path in sources.items()}
    changed = [name for name in sources if recorded is not None and recorded.get(name) != hashes[name]]
    if changed:
        raise ValueError(f"{changed} differ from their manifest; nothing was published")
    os.makedirs(target, exist_ok=True)
    copies = {name: os.path.join(target, name) for name in sources}
    try:
        for name, path in sources.items():
            shutil.copyfile(path, copies[name])
            if not file_hash(copies[name]) == hashes[name] == file_hash(path):
                raise OSError(f"the copy of {path} differs")
    except BaseException:
        for copy in copies.values():
            if os.path.exists(copy):
                os.remove(copy)
        raise
    return hashes


def staged_apply(changes: dict[str, tuple[str, bytes]], backup: str) -> None:
    """Replace files in place: ``{path: (expected hash, new bytes)}``.

    All hashes are checked before anything changes; the old bytes go to an empty backup folder;
    if a replacement can't be verified all files are restored.
    """
    for path, (expected, _) in changes.items():
        if file_hash(path) != expected:
            raise ValueError(f"{path} has changed; nothing was replaced")
    fresh(backup)
    os.makedirs(backup, exist_ok=True)
    saved = {}
    for i, path in enumerate(changes):
        saved[path] = os.path.join(backup, f"{i:04d}-{os.path.basename(path)}")
        shutil.copyfile(path, saved[path])
    try:
        for path, (_, new) in changes.items():
            with open(f"{path}.tmp", "wb") as f:
                f.write(new)
            os.replace(f"{path}.tmp", path)
            with open(path, "rb") as f:
                if f.read() != new:
                    raise OSError(f"{path} was not written as given")
    except BaseException:
        for path, old in saved.items():
            shutil.copyfile(old, path)
        raise
