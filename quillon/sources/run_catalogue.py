"""Saved runs as a table whose folders are found by what is asked for.

A run lies at …/TEST_SIZE/seedN/FEATURES/ABLATION/EMBEDDER/CONFIG/MODEL_loss_model.pt.
Filters on these columns (equal to, or one of) are pushed to the source: planning
descends to the seeds' folders, past none that a filter forbids, and tasks list
what is below them, again without the forbidden ones. Nothing is opened. Spark
applies the filters again to the rows. Other columns are as runs.parse_run_path
gives them; paths that are no runs' have no row. Folders are listed by pyarrow.fs.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, timestamp string, test_size double, seed int, feature_type string, edge_ablation string, embedder string, feature_config string, model string, loss string, run_dir string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ENDING = "_model.pt"
TASKS = 256


def of_folders(parts: list[str]) -> dict:
    """What a path's folders say as far as they go, from the one before the seed on; empty before there is a seed."""
    at = next((i for i, x in enumerate(parts) if re.fullmatch("seed[0-9]+", x)), 0)
    if at < 1:
        return {}
    try:
        found = {"test_size": float(parts[at - 1]), "seed": int(parts[at][4:])}
    except ValueError:
        return {"test_size": None}
    if found["seed"] >= 1 << 31:
        return {"test_size": None}
    found |= dict(zip(("feature_type", "edge_ablation", "embedder", "feature_config"), parts[at + 1 : at + 5]))
    if "embedder" in found:
        found["embedder"] = found["embedder"].replace("_", "/", 1)
    return found | {"timestamp": parts[at - 2] if at >= 2 else None}


def of_file(path: str) -> tuple | None:
    """The row of a run, by its path."""
    parts = path.replace("\\", "/").split("/")
    found = of_folders(parts[:-1])
    if "feature_config" not in found:
        return None
    model, _, loss = parts[-1].removesuffix(ENDING).partition("_")
    return tuple((found | {"path": path, "model": model, "loss": loss, "run_dir": "/".join(parts[:-1])})[c] for c in NAMES)


class Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class RunReader(DataSourceReader):
    """listed: the folders that this object has listed, for tests."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.asked: dict[str, list] = {}
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = list(f.value) if isinstance(f, In) else [f.value]
                known = self.asked.get(f.attribute[0], values)
                self.asked[f.attribute[0]] = [v for v in known if v in values]
            yield f

    def _allowed(self, folder: str) -> bool:
        found = of_folders(folder.split("/"))
        if "test_size" in found and found["test_size"] is None:
            return False
        return all(found[c] in values for c, values in self.asked.items() if c in found)

    def _list(self, folder: str) -> tuple[list[str], list[str]]:
        """Folders and saved models in a folder."""
        from pyarrow import fs

        self.listed.append(folder)
        system, local = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        found = sorted(system.get_file_info(fs.FileSelector(local)), key=lambda x: x.base_name)
        paths = lambda kind: [f"{folder}/{x.base_name}" for x in found if x.type == kind]
        return paths(fs.FileType.Directory), [p for p in paths(fs.FileType.File) if p.endswith(ENDING)]

    def _below(self, folder: str, to_seeds: bool) -> Iterator[str]:
        """With to_seeds the seeds' folders, else saved models, without passing a forbidden folder."""
        folders, models = self._list(folder)
        if not to_seeds:
            yield from models
        for child in folders:
            if self._allowed(child):
                if to_seeds and of_folders(child.split("/")):
                    yield child
                else:
                    yield from self._below(child, to_seeds)

    def partitions(self) -> list[InputPartition]:
        seeds = [self.root] if of_folders(self.root.split("/")) else list(self._below(self.root, True))
        tasks = [seeds[i::TASKS] for i in range(min(TASKS, len(seeds)))]
        return [Folders(x) for x in tasks] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            for path in self._below(folder, False):
                row = of_file(path)
                if row is not None:
                    yield row


class RunCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        return RunReader(self.options["path"])


def saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs below root; ask with where(), or runs.lookup, and only folders that may fit are listed."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's process need not know this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunCatalogue)
    return spark.read.format(RunCatalogue.name()).load(root)
