"""A folder of published datasets: <root>/<name>/data/<version>/<split> in Parquet, manifests and a README.md beside it.

A push writes all splits into a folder of its own and only then commits: a manifest with the next number names the
folder and its splits. Readers take the last complete manifest, so they see all of a push or nothing of it, and what they
read stays while the next push is written. Manifests are created only where there is none of that number yet: of two
pushes at once one fails, before anything of the other is touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.functions.targets import histogram

from .tables import KIND_TAGS, TARGET_TAGS, column_classes, counted, read_splits, table_tags, with_section

WHOLE = "whole_dataset"
#: Versions that stay when a new one is committed: readers of the one before it may still be at work.
KEEP = 2
# Headers of the sections that are kept up to date.
SECTIONS = {
    "targets": "**Machine Learning - Properties / Targets**",
    "features": "**Machine Learning - Embeddings**",
    "size": "**Dataset Size**",
    "splits": "**Available Data Splits**",
    "figures": "**Figures**",
}


class Store:
    """Datasets below ``root``, which may lie in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> tuple[object, object]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def names(self) -> list[str]:
        return self._names(self.root)

    def _read(self, path: str) -> str:
        fs, at = self._path(path)
        if not fs.exists(at):
            return ""
        with_stream = fs.open(at)
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def _create(self, path: str, text: str, *, overwrite: bool) -> None:
        fs, at = self._path(path)
        out = fs.create(at, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def manifests(self, name: str) -> dict[int, dict]:
        """The complete manifests of a dataset by number: folder, splits (in order)."""
        fs, at = self._path(f"{self.root}/{name}/manifests")
        found = {}
        for path in sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []:
            try:
                found[int(path.rpartition("/")[2].partition(".")[0])] = json.loads(self._read(path))
            except ValueError:  # not written to its end yet
                continue
        return found

    def versions(self, name: str) -> list[int]:
        return sorted(self.manifests(name))

    def _manifest(self, name: str, version: int | None = None) -> dict:
        found = self.manifests(name)
        if version is not None and version not in found:
            raise FileNotFoundError(f"{self.root}/{name}, version {version}")
        return found[max(found) if version is None else version] if found else {"folder": "", "splits": []}

    def splits(self, name: str, version: int | None = None) -> list[str]:
        return sorted(self._manifest(name, version)["splits"])

    def push(self, data: DataFrame | dict[str, DataFrame], name: str, keep: int = KEEP) -> list[str]:
        """Store a table, or splits by name, as the next version; ``keep`` versions stay. Returns the splits that the one before had besides.

        A push that fails on the way leaves what was stored as it was.
        """
        parts = {WHOLE: data} if isinstance(data, DataFrame) else data
        number = max(self.versions(name), default=0) + 1
        folder = f"{number:06d}-{uuid.uuid4().hex}"
        for split, df in parts.items():
            df.write.parquet(f"{self.root}/{name}/data/{folder}/{split}")
        before = self.splits(name)
        self._create(f"{self.root}/{name}/manifests/{number:06d}.json", json.dumps({"folder": folder, "splits": list(parts)}), overwrite=False)
        self.expire(name, keep)
        return [s for s in before if s not in parts]

    def expire(self, name: str, keep: int = KEEP) -> list[int]:
        """Remove all versions but the last ``keep``; returns their numbers. Folders of pushes that are not committed stay."""
        found = self.manifests(name)
        gone = sorted(found)[: -max(1, keep)]
        for number in gone:
            for path in (f"{self.root}/{name}/manifests/{number:06d}.json", f"{self.root}/{name}/data/{found[number]['folder']}"):
                fs, at = self._path(path)
                fs.delete(at, True)
        return gone

    def split_paths(self, name: str, version: int | None = None) -> dict[str, str]:
        at = self._manifest(name, version)
        return {s: f"{self.root}/{name}/data/{at['folder']}/{s}" for s in sorted(at["splits"])}

    def pull(self, name: str, combine: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The whole dataset: its one split, the one named whole_dataset, or those to combine. Several without either is an error.

        ``version``: one that is still stored, instead of the last.
        """
        paths = self.split_paths(name, version)
        found = list(paths)
        if not found:
            raise FileNotFoundError(f"{self.root}/{name}")
        if not combine and len(found) > 1 and WHOLE not in found:
            raise ValueError(f"name the splits to combine: {found}")
        return read_splits(self.spark, paths[found[0]].rpartition("/")[0], combine or (found if len(found) == 1 else [WHOLE]))

    def read_me(self, name: str) -> str:
        return self._read(f"{self.root}/{name}/README.md")

    def update_read_me(self, name: str, bins: int = 50) -> str:
        """Write the sections on targets, features, size, splits, and the histogram of each numeric target."""
        df, text = self.pull(name), self.read_me(name) or f"# {name}\n\n\n"
        kinds, numeric = column_classes(df), {c for c, t in df.dtypes if t in ("int", "bigint", "float", "double")}
        sizes = {c: df.select(c).distinct().limit(3).count() for c in kinds["targets"]}
        points = {
            "targets": [f"{c} - {'classification' if sizes[c] < 3 else 'regression'}" for c in kinds["targets"]],
            "features": kinds["features"],
            "size": [f"{df.count()} datapoints"],
            "splits": kinds["splits"] + self.splits(name),
            "figures": [f"{c}: " + " ".join(f"{r['bin']}:{r['n']}" for r in histogram(df, c, bins).orderBy("bin").collect()) for c in kinds["targets"] if c in numeric],
        }
        for key, header in SECTIONS.items():
            text = with_section(text, header, points[key])
        self._create(f"{self.root}/{name}/README.md", text, overwrite=True)
        return text

    def publish(self, df: DataFrame, name: str, pipeline: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Run ``pipeline`` over a table, store the result as one split, and bring its README up to date."""
        self.push(pipeline(df) if pipeline else df, name)
        self.update_read_me(name)
        return self.pull(name)

    def explore(self, log: str | None = None) -> DataFrame:
        """name, tags, target_tags, split_info, full_size, last_modified, features of every dataset; ``log``: also as a CSV file.

        One job counts the rows of all splits, from the files' footers.
        """
        rows = []
        parts = {(name, s): self.spark.read.parquet(path) for name in self.names() for s, path in self.split_paths(name).items()}
        sizes = {r["name"]: r["n_rows"] for r in counted({f"{n}/{s}": df for (n, s), df in parts.items()}).collect()} if parts else {}
        for name in self.names():
            counts = {s: sizes[f"{n}/{s}"] for n, s in parts if n == name}
            columns = next((df.columns for (n, _), df in parts.items() if n == name), [])
            fs, at = self._path(f"{self.root}/{name}/manifests" if counts else f"{self.root}/{name}")
            info = ", ".join(f"{s}: {n}" for s, n in counts.items())
            rows.append((name, ", ".join(table_tags(columns, KIND_TAGS)), ", ".join(table_tags(columns, TARGET_TAGS)), info, sum(counts.values()), fs.getFileStatus(at).getModificationTime(), ", ".join(columns)))
        kind = "name string, tags string, target_tags string, split_info string, full_size long, last_modified long, features string"
        out = self.spark.createDataFrame(rows, kind).withColumn("last_modified", F.timestamp_millis("last_modified"))
        if log:
            out.coalesce(1).write.mode("overwrite").csv(log, header=True)  # a row for each dataset
        return out
