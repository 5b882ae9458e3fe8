"""Live change detection: a streaming source that watches a tree, and a debounce by timer.

    spark.dataSource.register(TreeSource)
    rows = spark.readStream.format("tree").option("path", "/data/repo").load()
    quiet = settled(rows, 150)
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewarden.functions.rules import IGNORED
from tracewarden.functions.scalar import LANGUAGE
from tracewarden.schema import CHANGES


class Paths(InputPartition):
    """Paths to read, and paths that are gone."""

    def __init__(self, changed: list[str], gone: list[str]):
        super().__init__(None)
        self.changed, self.gone = changed, gone


class TreeReader(DataSourceStreamReader):
    """Offsets are listings of the tree ({path: [modification time, length]}); rows are the differences of two of them.

    Listings live in the stream's checkpoint, so a restart reports what changed meanwhile, deletions included. A file that
    changes again while it is read is read as it then is, and reported again by the next listing. A listing is as long as the tree
    has source files; contents are read by the tasks, which must see the tree at the same place.
    """

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.tasks = max(1, int(options.get("tasks", "8")))

    def _listing(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f not in IGNORED)
            for name in names:
                if name.rpartition(".")[2].lower() in LANGUAGE:
                    path = os.path.join(folder, name)
                    try:
                        state = os.stat(path)
                    except FileNotFoundError:  # gone between the two calls
                        continue
                    found[os.path.relpath(path, self.root)] = [state.st_mtime_ns, state.st_size]
        return found

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._listing(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Paths]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        changed = sorted(p for p, state in new.items() if old.get(p) != state)
        gone = sorted(p for p in old if p not in new)
        tasks = min(self.tasks, max(1, len(changed)))
        return [Paths(changed[k::tasks], gone if k == 0 else []) for k in range(tasks)] if changed or gone else []

    def read(self, partition: Paths):
        from datetime import datetime, timezone

        now = datetime.now(timezone.utc)
        for path in partition.gone:
            yield path, LANGUAGE[path.rpartition(".")[2].lower()], True, None, now
        for path in partition.changed:
            language = LANGUAGE[path.rpartition(".")[2].lower()]
            try:
                with open(os.path.join(self.root, path), "rb") as file:
                    yield path, language, False, file.read().decode("utf-8", "replace"), now
            except FileNotFoundError:  # gone since the listing
                yield path, language, True, None, now


class TreeSource(DataSource):
    """``path``: a folder that driver and tasks see; ``tasks``: most tasks that read a batch's files (8)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


_STATE = "language string, is_delete boolean, content string, event_time timestamp, due long"


class Quiet(StatefulProcessor):
    """Keeps the last change of a path and emits it when its timer fires; each change sets the timer anew."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        newest = self.last.get() if self.last.exists() else None
        if newest is not None:
            self.handle.deleteTimer(newest[4])
            newest = tuple(newest[:4])
        for frame in rows:
            for row in zip(frame["language"], frame["is_delete"], frame["content"], frame["event_time"]):
                if newest is None or row[3] >= newest[3]:
                    newest = row
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.last.update((newest[0], None if newest[1] is None else bool(newest[1]), newest[2], newest[3], due))
        self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            language, is_delete, content, at, _ = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"path": [key[0]], "language": [language], "is_delete": [is_delete], "content": [content], "event_time": [at]})

    def close(self) -> None:
        pass


def settled(changes: DataFrame, quiet_ms: int = 150) -> DataFrame:
    """The last change of each path once the path was quiet for ``quiet_ms`` of the clock, without any later event.

    Ties of time: the row that comes later counts. State is one change a path. Needs the RocksDB state store.
    """
    return changes.groupBy("path").transformWithStateInPandas(Quiet(quiet_ms), CHANGES, "Append", "ProcessingTime")
