"""Tables from and to files, similarity matrices, what a table's column names tell."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _resolved(spark: SparkSession, path: str) -> str:
    """``path``, or the one file in its folder that differs from it in case only; through Hadoop's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return path
    if at.getParent() is not None and fs.exists(at.getParent()):
        for s in fs.listStatus(at.getParent()):
            if s.getPath().getName().lower() == at.getName().lower():
                return s.getPath().toString()
    raise FileNotFoundError(path)


def read_table(spark: SparkSession, path: str, *, nested: bool = False) -> DataFrame:
    """CSV (header, inferred types), Parquet or Excel (first sheet, with openpyxl installed), by the name's ending.

    ``nested``: CSV columns that hold arrays or objects as JSON become arrays and structs again.
    """
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "csv":
        found = spark.read.csv(_resolved(spark, path), header=True, inferSchema=True, escape='"')
        return with_nested(found) if nested else found
    if end == "parquet":
        return spark.read.parquet(_resolved(spark, path))
    if end in ("xls", "xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise TypeError(f"cannot read files that end in {end!r}")


def with_nested(df: DataFrame) -> DataFrame:
    """``df`` with those text columns parsed that hold a JSON array or object in each row that is not null, and in one at least.

    One aggregate over all text columns finds the type that all rows of a column have in common: whole numbers are long,
    others double.
    """
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    own = {c: F.col(f"`{c}`") for c in texts}
    coded = {c: F.when(F.ltrim(x).rlike(r"^[\[{]"), F.try_parse_json(x)) for c, x in own.items()}
    found = df.agg(*(f.alias(f"{k}{i}") for i, c in enumerate(texts) for k, f in (("bad", F.count_if(own[c].isNotNull() & coded[c].isNull())), ("n", F.count(own[c])), ("kind", F.schema_of_variant_agg(coded[c]))))).first()
    kinds = {c: found[f"kind{i}"] for i, c in enumerate(texts) if found[f"n{i}"] and not found[f"bad{i}"]}
    plain = lambda k: re.sub(r"\b(VOID|VARIANT)\b", "STRING", re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", k.replace("OBJECT<", "STRUCT<")))
    return df.withColumns({c: F.from_json(own[c], plain(k)) for c, k in kinds.items() if k.startswith(("ARRAY", "OBJECT"))})


def read_splits(spark: SparkSession, folder: str, names: list[str] | None = None, column: str | None = None) -> DataFrame:
    """All split tables (subfolders, or files named as the split) of a folder as one; ``column`` takes the split's name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))}
    chosen = {n.rsplit(".", 1)[0]: p for n, p in sorted(found.items()) if not names or n.rsplit(".", 1)[0] in names}
    if not chosen or (names and set(names) - set(chosen)):
        raise ValueError(f"splits of {folder}: {sorted(n.rsplit('.', 1)[0] for n in found)}")
    parts = []
    for name, path in chosen.items():
        df = read_table(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)
        parts.append(df.withColumn(column, F.lit(name)) if column else df)
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def rename_stored(spark: SparkSession, path: str, names: dict[str, str], target: str) -> DataFrame:
    """A stored table under ``target`` with renamed columns; a name that is not there, or taken, is an error."""
    df = read_table(spark, path)
    if missing := set(names) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns of one name")
    write_table(df.withColumnsRenamed(names), target)
    return spark.read.parquet(target)


#: Characters that column names should not hold.
AWKWARD = " /."


def awkward_columns(columns: list[str]) -> list[str]:
    """Names that hold a blank, a slash or a dot."""
    return [c for c in columns if any(x in c for x in AWKWARD)]


def folder(kind: str = "") -> str:
    """The base folder, or that of ``data``, ``results`` or ``checkpoints``: named in STRANDFORGE_DIR or STRANDFORGE_DATA_DIR and so on, else below the base."""
    base = os.environ.get("STRANDFORGE_DIR", "~/strandforge")
    return os.path.expanduser(os.environ.get(f"STRANDFORGE_{kind.upper()}_DIR", f"{base}/{kind}") if kind else base)


def stem_and_ending(name: str) -> tuple[str, str]:
    """A file's name without its ending, and the ending with its dot."""
    stem, ending = os.path.splitext(name)
    return stem, ending


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(data: DataFrame | dict[str, DataFrame], path: str) -> list[str]:
    """CSV with header, nested columns as JSON; of several splits, one folder each, named stem_split.csv."""
    if isinstance(data, dict):
        head, slash, name = path.rpartition("/")
        stem, dot, rest = name.partition(".")
        return [p for split, df in data.items() for p in write_csv(df, f"{head}{slash}{stem}_{split}{dot}{rest}")]
    nested = {f.name: F.to_json(f"`{f.name}`") for f in data.schema if isinstance(f.dataType, ArrayType | MapType | StructType)}
    data.withColumns(nested).write.mode("overwrite").csv(path, header=True, escape='"')
    return [path]


def similarity_table(lines: DataFrame, name: str, alphabet: str) -> DataFrame:
    """matrix, row_sym, col_sym, score of a white-space matrix given as (line_no, value); other symbols are left out.

    Rows and columns must have the same symbols, and hold all of the alphabet.
    """
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("line_no", F.split(F.trim("value"), r"\s+").alias("t"))
    head = rows.orderBy("line_no").first()
    if head is None:
        raise ValueError("an empty matrix")
    names = list(head["t"])
    body = rows.where(F.col("line_no") > head["line_no"])
    wide = body.select(F.col("t")[0].alias("row_sym"), F.slice("t", 2, F.size("t")).alias("v"))
    if wide.where(F.size("v") != len(names)).limit(1).count() or sorted(names) != sorted(r[0] for r in wide.select("row_sym").collect()):  # a symbol per row
        raise ValueError("rows and columns differ")
    if missing := set(alphabet) - set(names):
        raise ValueError(f"no scores for {sorted(missing)}")
    long = wide.select("row_sym", F.posexplode("v").alias("i", "score")).withColumn("col_sym", F.get(F.array(*map(F.lit, names)), F.col("i")))
    wanted = list(alphabet)
    return long.where(F.col("row_sym").isin(wanted) & F.col("col_sym").isin(wanted)).select(F.lit(name).alias("matrix"), "row_sym", "col_sym", F.col("score").cast("double").alias("score"))


def load_similarity(spark: SparkSession, folder: str, name: str, alphabet: str, *, replace: bool = False) -> DataFrame:
    """matrix, row_sym, col_sym, score of the file ``name`` in a folder; the ordered table is stored beside it and used from then on,
    unless ``replace`` is set."""
    stored = f"{folder}/{name}_ordered"
    at = spark._jvm.org.apache.hadoop.fs.Path(stored)
    if replace or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        lines = spark.read.text(f"{folder}/{name}", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
        similarity_table(lines, name, alphabet).coalesce(1).write.mode("overwrite").csv(stored, header=True)  # a cell for each pair of symbols
    return spark.read.csv(stored, header=True, schema="matrix string, row_sym string, col_sym string, score double")


def similarity_array(matrix: DataFrame, alphabet: str) -> list[list[float]]:
    """The scores as rows in the order of the alphabet."""
    cells = {(r["row_sym"], r["col_sym"]): r["score"] for r in matrix.collect()}  # a cell for each pair of symbols
    return [[cells[a, b] for b in alphabet] for a in alphabet]


def similarity_score(first: Column, second: Column, scores: list[list[float]], alphabet: str) -> Column:
    """Sum of the scores of two aligned sequences, place by place; null where their lengths differ, an error for unknown symbols."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in scores))
    strange = F.translate(F.concat(first, second), alphabet, "")
    checked = F.when(strange != "", F.raise_error(F.concat(F.lit("unknown symbols in sequence: "), strange)).cast("string")).otherwise(first)
    places = F.zip_with(F.split(checked, ""), F.split(second, ""), lambda a, b: F.get(F.get(table, F.instr(F.lit(alphabet), a) - 1), F.instr(F.lit(alphabet), b) - 1))
    total = F.aggregate(places, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.length(first) == F.length(second)) & (first == ""), 0.0).when(F.length(first) == F.length(second), total)


def with_section(text: str, header: str, points: list[str]) -> str:
    """``text`` with the section under ``header`` (up to three line ends) replaced, or added at the end."""
    section = f"{header}\n\n" + "".join(f"- {p}\n" for p in points) + "\n\n"
    at = text.find(header)
    if at < 0:
        return text + section
    end = text.find("\n\n\n", at)
    return text[:at] + section + (text[end + 3 :] if end >= 0 else "")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows of named tables, one at least: one job for all of them, that reads no column, only the files' footers."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, n_columns, features, targets, splits of named tables."""
    kind = "name string, n_columns int, features string, targets string, splits string"
    told = [(name, len(df.columns), *(",".join(column_classes(df)[k]) for k in ("features", "targets", "splits"))) for name, df in tables.items()]
    sizes = counted(tables) if tables else spark.createDataFrame([], "name string, n_rows long")
    return sizes.join(F.broadcast(spark.createDataFrame(told, kind)), "name").select("name", "n_rows", "n_columns", "features", "targets", "splits")  # a row for each table


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "index" and "split" not in c and not c.startswith("target")]


@dataclass(frozen=True)
class TagPattern:
    """``tag`` for tables in whose column names one of the patterns occurs; ``whole``: all of them."""

    tag: str
    patterns: tuple[str, ...]
    whole: bool = False


# Tags of tables and of targets, and the parts of column names that earn them.
KIND_TAGS = [TagPattern("_MOL", ("bnd_type", "atm_type", "bnd_idcs"), True), TagPattern("_PE", ("aa_",)), TagPattern("_DNA", ("dna_",))]
TARGET_TAGS = [TagPattern("_SOL", ("solubility",)), TagPattern("at_least_one_feature_named_TARGET", ("target",))]


def table_tags(columns: list[str], patterns: list[TagPattern] | None = None) -> list[str]:
    """Tags whose patterns occur in the column names."""
    occurs = lambda p: any(p in c for c in columns)
    return [t.tag for t in (KIND_TAGS + TARGET_TAGS if patterns is None else patterns) if (all if t.whole else any)(map(occurs, t.patterns))]


def column_classes(df: DataFrame) -> dict[str, list[str]]:
    """Columns by what they are: features, targets, splits."""
    return {"features": feature_columns(df), "targets": [c for c in df.columns if c.startswith("target")], "splits": [c for c in df.columns if "split" in c]}
