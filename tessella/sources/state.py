"""Named state tables as Parquet, in parts that are replaced one by one, with one manifest for all of them.

A table is made of parts (the rows of one source, or of one batch). Writing a part makes a new folder; what counts is the manifest, a
small numbered file that names the folder of every part of every table. It is written last, and never over another: a reader sees the
state before or after a transaction, whatever was being written when a job was lost, and of two writers that began with the same
manifest the second fails. Adding a source costs what the source has, not what the tables have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of each module, for clean-up.
MODULES = {
    "names": ("field_grams", "attribute_grams"),
    "tokens": ("field_tokens", "attribute_tokens", "attribute_token_idf"),
    "values": ("field_values", "attribute_values"),
    "numbers": ("field_moments", "attribute_moments"),
    "scores": ("raw_scores", "composite_scores"),
    "pairs": ("token_counts", "entity_counts", "inserted_tokens", "inserted_vectors", "inserted_numbers", "scored_pairs", "edges", "clusters"),
    "categories": ("category_features", "category_tokens", "entity_categories"),
    "local": ("local_sources", "local_fields", "local_entities", "local_data"),
    "global": ("attributes", "mappings", "rejected_mappings", "suggested_attributes", "synonyms"),
}
#: Configuration defaults.
DEFAULTS = {
    "cat_sample": "100000", "cat_count": "100", "cat_k": "1", "bins_count": "4", "prob_dist_threshold": "0.05", "rel_perf_threshold": "500", "abs_perf_threshold": "0.2", "truncate_threshold": "0.9",
    "question_budget": "50", "expected_dup_prob": "0.0005", "questions_sample_size": "100000", "question_sample_sources": "10", "cluster_aggresivness": "2.0",
}


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the manifest."""


class StateStore:
    """Tables below a folder of a file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, dict[str, str]] | None = None

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _load(self, number: int) -> dict[str, dict[str, str]] | None:
        """The manifest of this number; null if its writer was lost before the end."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/manifests/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def manifest(self) -> dict[str, dict[str, str]]:
        """The folder of each part, by table: of the open transaction, or as last committed."""
        if self._open is not None:
            return self._open
        return next((m for n in reversed(self._numbers()) if (m := self._load(n)) is not None), {})

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes within become visible at the end together, or, if anything fails, none of them. Reads within see the writes."""
        if self._open is not None:
            yield
            return
        taken = self._numbers()
        before = self.manifest()
        self._open = {t: dict(parts) for t, parts in before.items()}
        try:
            yield
            after, self._open = self._open, None
            self._commit(after, taken)
        finally:
            self._open = None

    def _commit(self, tables: dict[str, dict[str, str]], taken: list[int]) -> None:
        fs, path = self._fs()
        number = (taken[-1] if taken else 0) + 1
        try:
            out = fs.create(path(f"{self.root}/manifests/{number:012d}"), False)
        except Exception as error:
            raise ConflictError(f"manifest {number} exists") from error
        out.write(bytearray(json.dumps({t: p for t, p in tables.items() if p}, sort_keys=True).encode()))
        out.close()
        self._sweep([*taken, number])

    def _sweep(self, numbers: list[int]) -> None:
        """Deletes what only manifests before the last two name; readers of the last but one may still be at work."""
        fs, path = self._fs()
        kept = {f for n in numbers[-2:] for parts in (self._load(n) or {}).values() for f in parts.values()}
        for n in numbers[:-2]:
            for parts in (self._load(n) or {}).values():
                for folder in set(parts.values()) - kept:
                    fs.delete(path(f"{self.root}/{folder}"), True)
            fs.delete(path(f"{self.root}/manifests/{n:012d}"), False)

    def parts(self, name: str) -> list[str]:
        return sorted(self.manifest().get(name, {}))

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def read(self, name: str, *parts: str) -> DataFrame:
        """The rows of a table, or of some of its parts."""
        known = self.manifest().get(name, {})
        return self.spark.read.parquet(*[f"{self.root}/{known[p]}" for p in parts or sorted(known)])

    def put(self, name: str, part: str, rows: DataFrame) -> None:
        """Replaces one part of a table."""
        folder = f"{name}/{part}/{uuid.uuid4().hex}"
        with self.transaction():
            rows.write.parquet(f"{self.root}/{folder}")
            self._open.setdefault(name, {})[part] = folder

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replaces the whole table by one part."""
        with self.transaction():
            self.put(name, "all", rows)
            self._open[name] = {"all": self._open[name]["all"]}
        return self.read(name)

    def replace(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with the same keys are replaced by the new ones, others stay: for small tables, as the whole is written."""
        if not self.exists(name):
            return self.write(name, rows)
        old = self.read(name)
        return self.write(name, old.join(rows.select(keys).distinct(), keys, "left_anti").select(old.columns).unionByName(rows, allowMissingColumns=True))

    def append(self, name: str, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds the rows as a part of their own. A batch's name makes a retry replace what the first try added."""
        self.put(name, f"batch-{batch}" if batch is not None else f"added{len(self.parts(name)):06d}", rows)
        return self.read(name)

    def drop(self, name: str, *parts: str) -> None:
        """Takes a table, or some of its parts, out of the state."""
        with self.transaction():
            for p in parts or self.parts(name):
                self._open.get(name, {}).pop(p, None)

    def clean(self, *modules: str) -> None:
        """Drops the tables of modules; without names those of all."""
        with self.transaction():
            for name in reduce(lambda a, b: a + b, (MODULES[m] for m in modules or MODULES), ()):
                self.drop(name)

    def unload_local(self) -> None:
        self.clean("local", "names", "tokens", "values", "numbers")

    def config(self) -> DataFrame:
        """(name, value) with defaults for what was never set."""
        rows = self.spark.createDataFrame(sorted(DEFAULTS.items()), "name string, value string").withColumn("description", F.col("name"))
        return rows if not self.exists("configuration") else self.read("configuration").unionByName(rows.join(self.read("configuration"), "name", "left_anti"))

    def set_config(self, name: str, value: str) -> DataFrame:
        return self.replace("configuration", self.spark.createDataFrame([(name, value, name)], "name string, value string, description string"), ["name"])


def remove_source(table: DataFrame, entities: DataFrame, source_id: int, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """table without rows any of whose keys is an entity of the source."""
    gone = entities.where(F.col("source_id") == source_id).select("entity_id").distinct()
    for k in keys:
        table = table.join(gone.withColumnRenamed("entity_id", k), k, "left_anti").select(table.columns)
    return table


def rekey(mappings: DataFrame, keys: DataFrame) -> DataFrame:
    """mappings with global ids replaced by keys (global_id, new_id); ids without a key stay."""
    return mappings.join(keys, "global_id", "left").withColumn("global_id", F.coalesce("new_id", "global_id")).drop("new_id").select(mappings.columns)


def label_pair(questions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, matches): questions with labels (e1, e2, human_label) set, and pairs labelled yes in any case."""
    known = labels.select("e1", "e2", F.initcap("human_label").alias("new_label"))
    out = questions.join(known, ["e1", "e2"], "left").withColumn("human_label", F.coalesce("new_label", "human_label")).drop("new_label").select(questions.columns)
    return out, known.where("new_label = 'Yes'").select(F.col("e1").alias("entity_a"), F.col("e2").alias("entity_b"))
