"""Write, audit, publish: a group of tables becomes visible at once, or not at all."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tablemill.operators.validate import write_audited
from tablemill.scratch import stored
from tablemill.sources import files

#: Tables that are written at a time.
AT_ONCE = 5
#: Versions whose files stay.
KEPT = 2
#: What a publisher or a holder has said it uses is taken as abandoned after so many seconds.
ABANDONED = 7 * 24 * 3600
Audit = Callable[[dict[str, DataFrame], dict[str, DataFrame]], None]


class Rejected(RuntimeError):
    """An audit failed: the candidate stays for inspection and repair, the published version is untouched."""


class Conflict(RuntimeError):
    """Another publication came first: nothing was published."""


class Group:
    """A group of tables under root, in versions.

    A version is a small file, versions/<number>.json, with each table's place and content key; the highest one is
    published. A publication claims its number by making that file, so of two that began at the same version one is
    refused, and readers see a version or the next one. Tables are written to places of their own, so a candidate may be
    read while it is mended. The key of a table is the hash of its rows as they were written, taken in that pass.
    Unchanged tables stay where they are.

    A place goes when nothing names it: none of the KEPT last versions, no version that is held, not the candidate, and
    no publication that is under way.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = KEPT) -> None:
        self.spark, self.root, self.kept = spark, root, kept

    def _note(self, name: str) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.root}/{name}.json") or "{}")

    def _tables(self, note: dict) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.root}/{place}") for n, place in note.get("places", {}).items()}

    def _named(self, folder: str) -> list[str]:
        return [n.removesuffix(".json") for n in files.names(self.spark, f"{self.root}/{folder}") if n.endswith(".json")]

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read."""
        return sorted(map(int, self._named("versions")))

    def pointer(self) -> dict:
        """The note of the published version: its number, and each table's key and place."""
        there = self.versions()
        return self._note(f"versions/{there[-1]:09d}") if there else {}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The published tables, or those of an earlier version that is still there; none before the first publication."""
        if version is not None and version not in self.versions():
            raise LookupError(f"no version {version}")
        return self._tables(self.pointer() if version is None else self._note(f"versions/{version:09d}"))

    @contextmanager
    def hold(self, version: int | None = None) -> Iterator[dict[str, DataFrame]]:
        """Tables of a version, whose files stay until the block ends however often others publish meanwhile."""
        version = self.pointer().get("version") if version is None else version
        mark = f"{self.root}/holds/{uuid.uuid4().hex}.json"
        files.write_text(self.spark, mark, json.dumps({"version": version, "at": time.time()}))
        try:
            yield self.read(version) if version is not None else {}
        finally:
            files.delete(self.spark, mark)

    def candidate(self) -> dict[str, DataFrame]:
        """The tables of the last publication that was tried, published or rejected."""
        return self._tables(self._note("candidate"))

    def publish(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], audit: Audit | None = None, keys: Mapping[str, str] | None = None) -> bool:
        """Write what changed, run audit(new, old), publish. False if nothing had changed.

        keys: content keys known beforehand (by fingerprints); a table given as a function is computed only if its key
        changed, and a table whose key didn't isn't written. Other tables are evaluated once, to be written and hashed;
        if the hash is the old one, what was written goes again. An audit rejects by raising. Raises Conflict if another
        publication came first.
        """
        now = self.pointer()
        old, there, keys = now.get("tables", {}), now.get("places", {}), keys or {}
        number = now.get("version", 0) + 1
        folder = f"{number:09d}-{uuid.uuid4().hex[:8]}-{'odd' if number % 2 else 'even'}"
        same = {n for n in tables if n in old and keys.get(n) == old[n]}
        found, places = {n: old[n] for n in same}, {n: there[n] for n in same}

        def write(name: str) -> str:
            df = tables[name] if isinstance(tables[name], DataFrame) else tables[name]()
            return write_audited(df, f"{self.root}/{folder}/{name}.parquet").key

        under_way = f"{self.root}/under_way/{uuid.uuid4().hex}.json"
        files.write_text(self.spark, under_way, json.dumps({"folder": folder, "reads": [*there.values()], "at": time.time()}))
        try:
            todo = [n for n in tables if n not in same]
            with ThreadPoolExecutor(AT_ONCE) as pool:
                for name, seen in zip(todo, pool.map(write, todo), strict=True):
                    found[name] = keys.get(name, seen)
                    if name in old and found[name] == old[name]:
                        places[name] = there[name]
                        files.delete(self.spark, f"{self.root}/{folder}/{name}.parquet")
                    else:
                        places[name] = f"{folder}/{name}.parquet"
            if now and found == old:
                files.delete(self.spark, f"{self.root}/{folder}")
                return False
            note = {"version": number, "tables": found, "places": places}
            files.write_text(self.spark, f"{self.root}/candidate.json", json.dumps(note))
            if audit:
                try:
                    audit(self._tables(note), self._tables(now))
                except Exception as error:
                    raise Rejected(str(error)) from error
            if not files.claim_text(self.spark, f"{self.root}/versions/{number:09d}.json", json.dumps(note)):
                raise Conflict(f"version {number} is there already")
        finally:
            files.delete(self.spark, under_way)
        self.clean()
        return True

    def clean(self) -> None:
        """Remove versions beyond those kept or held, and places that nothing names."""

        def alive(folder: str) -> list[dict]:
            notes = [self._note(f"{folder}/{n}") for n in self._named(folder)]
            return [n for n in notes if n.get("at", 0) > time.time() - ABANDONED]

        held = {n["version"] for n in alive("holds")}
        keep = [v for k, v in enumerate(reversed(self.versions())) if k < self.kept or v in held]
        notes = [self._note(f"versions/{v:09d}") for v in keep] + [self._note("candidate")]
        busy = alive("under_way")
        used = {p for n in notes for p in n.get("places", {}).values()} | {p for n in busy for p in n["reads"]}
        for v in set(self.versions()) - set(keep):
            files.delete(self.spark, f"{self.root}/versions/{v:09d}.json")
        for folder in files.names(self.spark, self.root):
            if not folder[:1].isdigit() or folder in {n["folder"] for n in busy}:
                continue
            tables = files.names(self.spark, f"{self.root}/{folder}")
            gone = [t for t in tables if f"{folder}/{t}" not in used]
            for t in gone:
                files.delete(self.spark, f"{self.root}/{folder}/{t}")
            if len(gone) == len(tables):
                files.delete(self.spark, f"{self.root}/{folder}")

    def version(self) -> str:
        """A hash of the published tables."""
        return group_hash(self.pointer().get("tables", {}))


def group_hash(keys: Mapping[str, str]) -> str:
    return hashlib.md5("\n".join(f"{n}={k}" for n, k in sorted(keys.items())).encode()).hexdigest()


def materialize(df: DataFrame) -> DataFrame:
    """A sub-query computed once, for use in several places: written to the shared folder, so it survives lost
    executors, unlike a cache or a local checkpoint."""
    return stored(df)
