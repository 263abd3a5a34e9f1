"""Run folders as a Spark data source: ``spark.read.format("run_folders").load(root)``.

Below the root each run has a folder of its own, named by its id, with files in JSON, JSON lines or text.  A row is a record:
``run_id, path, kind, line, record, text, error``.  A folder is a partition, so a filter on ``run_id`` reads its folders only, and one on
``kind`` or ``path`` its files only.  A run that was not finished (it has a marker file) is refused: by a row with its error, or, with
``option("unfinished", "fail")``, by failing.  JSON is parsed strictly: duplicate keys, ``NaN`` and torn lines are errors of their own
row, never half a record.  The root has to be a path that every executor opens as a local or mounted folder; for other stores,
``spark.read.format("binaryFile")`` with ``runs.scan_findings`` does the same checks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .runs import INCOMPLETE

SCHEMA = "run_id string, path string, kind string, line bigint, record string, text string, error string"
#: Kind of a file by the end of its name.
KINDS = {".jsonl": "json_lines", ".json": "json"}
#: Files of evidence lie in this folder of a run.
EVIDENCE = "evidence"


def kind_of(path: str) -> str:
    if path.split("/")[0] == EVIDENCE:
        return "evidence"
    return next((kind for end, kind in KINDS.items() if path.endswith(end)), "text")


class StrictError(ValueError):
    pass


def _pairs(items: list[tuple[str, object]]) -> dict:
    out = dict(items)
    if len(out) < len(items):
        raise StrictError("duplicate key")
    return out


def _constant(name: str) -> None:
    raise StrictError(f"{name} is no JSON")


def strict_json(text: str) -> str:
    """The value as canonical JSON: compact, with keys in order."""
    value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def records(path: str, kind: str, data: bytes) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """``line, record, text, error`` of one file."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        yield 0, None, None, "not UTF-8"
        return
    if kind == "json_lines":
        lines = text.split("\n")
        torn = lines.pop() != ""
        for number, line in enumerate(lines if not torn else [*lines, text.rsplit("\n", 1)[-1]], 1):
            if torn and number == len(lines) + 1:
                yield number, None, line, "torn"
                continue
            yield number, *_parsed(line)
    elif kind == "json" or kind == "evidence" and path.endswith(".json"):
        whole = _parsed(text)
        if whole[2] == "not JSON" and text.count("\n") > 1:  # a file of lines under the other name
            yield from records(path, "json_lines", data)
        else:
            yield 1, *whole
    else:
        yield 1, None, text, None


def _parsed(text: str) -> tuple[str | None, str | None, str | None]:
    try:
        return strict_json(text), None, None
    except RecursionError:
        return None, text, "nested too deeply"
    except ValueError as error:
        return None, text, str(error) if isinstance(error, StrictError) else "not JSON"


class RunPartition(InputPartition):
    def __init__(self, run_id: str):
        super().__init__(run_id)
        self.run_id = run_id


class RunReader(DataSourceReader):
    def __init__(self, root: str, unfinished: str):
        self.root, self.unfinished = root, unfinished
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for found in filters:
            name = ".".join(found.attribute) if hasattr(found, "attribute") else ""
            if name in ("run_id", "kind", "path") and isinstance(found, EqualTo | In):
                values = {found.value} if isinstance(found, EqualTo) else set(found.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield found

    def partitions(self) -> list[RunPartition]:
        if "run_id" in self.wanted:  # nothing else is looked at
            names = [n for n in sorted(x for x in self.wanted["run_id"] if x) if "/" not in n and os.path.isdir(os.path.join(self.root, n))]
        else:
            names = sorted(e.name for e in os.scandir(self.root) if e.is_dir())
        return [RunPartition(n) for n in names]

    def read(self, partition: RunPartition) -> Iterator[tuple]:
        if partition is None:  # no folder is wanted
            return
        home = os.path.join(self.root, partition.run_id)
        if os.path.exists(os.path.join(home, INCOMPLETE)):
            if self.unfinished == "fail":
                raise StrictError(f"{partition.run_id} was not finished")
            if self._takes("path", INCOMPLETE) and self._takes("kind", "marker"):
                yield partition.run_id, INCOMPLETE, "marker", None, None, None, "unfinished"
            return
        for folder, below, names in os.walk(home):
            below.sort()
            for name in sorted(names):
                path = os.path.relpath(os.path.join(folder, name), home).replace(os.sep, "/")
                kind = kind_of(path)
                if self._takes("path", path) and self._takes("kind", kind):
                    with open(os.path.join(folder, name), "rb") as file:
                        for line, record, text, error in records(path, kind, file.read()):
                            yield partition.run_id, path, kind, line, record, text, error

    def _takes(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]


class RunFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        path = self.options["path"]
        scheme, _, rest = path.rpartition("://") if "://" in path else ("file", "", path.removeprefix("file:"))
        if scheme != "file":
            raise StrictError(f"{scheme} is read by binaryFile, not by run_folders")
        return RunReader(rest, self.options.get("unfinished", "row"))


def register(spark) -> None:
    """Make the source known to a session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunFolders)
