"""Eval-set sources and sinks.

Readers always return one typed DataFrame
``(eval_id, question, original_question, gold_sql, issues)`` whatever the
input (table name, parquet folder, CSV with multi-line quoted SQL, JSON
array), with explicit schemas (no inference pass over the data).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, fields, is_dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_SCHEMA = T.StructType([
    T.StructField("eval_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("original_question", T.StringType()),
    T.StructField("gold_sql", T.StringType()),
    T.StructField("issues", T.StringType()),
])

# Column names seen for the gold query in eval-set files.
GOLD_NAMES = ("gold_sql", "ground_truth_query", "ground_truth_sql")


def is_three_part(name: str) -> bool:
    return name.count(".") == 2 and all(p.strip() for p in name.split("."))


def _to_eval(df: DataFrame) -> DataFrame:
    """Typed eval rows; a row's gold is the first non-null of the known gold names."""
    golds = [F.col(c).cast("string") for c in GOLD_NAMES if c in df.columns]
    gold = F.coalesce(*golds) if golds else F.lit(None).cast("string")
    if "question" not in {c.lower() for c in df.columns}:
        raise ValueError(f"eval set needs a question column, got {df.columns}")
    own = F.sha2(F.concat_ws("\u0001", F.col("question"), F.coalesce(gold, F.lit(""))), 256)
    first = lambda name, other: (F.coalesce(F.col(name).cast("string"), other)
                                 if name in df.columns else other)
    return df.select(
        first("eval_id", own).alias("eval_id"),
        F.col("question").cast("string").alias("question"),
        first("original_question", F.col("question").cast("string")).alias("original_question"),
        gold.alias("gold_sql"),
        (F.col("issues") if "issues" in df.columns else F.lit(None)).cast("string").alias("issues"),
    )


def read_eval_table(spark: SparkSession, name: str) -> DataFrame:
    """A1: eval set by three-part table name (catalog.schema.table)."""
    if not is_three_part(name):
        raise ValueError(f"expected a three-part table name, got {name!r}")
    return _to_eval(spark.table(name))


def read_eval_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _to_eval(spark.read.parquet(path))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2: CSV with a header and multi-line quoted SQL ("" escapes a quote).
    The header decides which gold column name is used."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    return _to_eval(df)


def read_eval_json(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """A3: JSON ``lines`` (one object a line) or a JSON ``array`` of objects (its file
    is one row, so arrays are for files that fit a task).  Text that is not of
    the stated form fails; nothing after the first record is passed over."""
    names = ("eval_id", "question", "original_question", *GOLD_NAMES, "issues")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    if form == "lines":
        return _to_eval(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    if form != "array":
        raise ValueError(f"unknown form {form!r}")
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    whole = F.when(text.startswith("[") & text.endswith("]"), text).otherwise(
        F.raise_error(F.lit("not one JSON array")))
    parsed = F.from_json(whole, T.ArrayType(schema), {"mode": "FAILFAST"})
    return _to_eval(spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("r")).select("r.*"))


_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def _field_type(annotation) -> T.DataType:
    """Spark type of a dataclass field's annotation; what has no own type becomes text."""
    name = annotation if isinstance(annotation, str) else getattr(annotation, "__name__", str(annotation))
    return _TYPES.get(name.replace("Optional[", "").rstrip("]").split("|")[0].strip(), T.StringType())


def to_rows(spark: SparkSession, items, schema: T.StructType | None = None) -> DataFrame:
    """Entity objects (dataclasses or dicts) -> one DataFrame, batched."""
    rows = [asdict(x) if is_dataclass(x) else dict(x) for x in items]
    if schema is None and items and is_dataclass(items[0]):
        schema = T.StructType([T.StructField(f.name, _field_type(f.type)) for f in fields(items[0])])
        text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
        rows = [{k: (str(v) if k in text and v is not None else v) for k, v in r.items()} for r in rows]
    return spark.createDataFrame(rows, schema)


def _version_tag() -> str:
    import time
    now = time.time()
    return time.strftime("%Y%m%d%H%M%S", time.gmtime(now)) + f"{int(now * 1000) % 1000:03d}"


def write_table(df: DataFrame, base: str, mode: str = "append", versioned: bool = False) -> str:
    """A5: write a table folder.  ``versioned`` writes a new ``v=<utc time>``
    partition folder, so a table is never overwritten while it is read (the
    source of the write may be the previous version).  Schema evolution on
    read: ``read_table(..., merge_schema=True)``."""
    if mode not in ("append", "overwrite", "error", "ignore"):
        raise ValueError(f"bad mode {mode!r}")
    target = base
    if versioned:
        target = f"{base.rstrip('/')}/v={_version_tag()}"
        mode = "error"
    df.write.mode(mode).parquet(target)
    return target


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """Latest finished version of a versioned table.  Versions are folder names,
    listed through the file system; one without ``_SUCCESS`` is still being
    written (or was broken off) and is passed over.  Only the chosen folder is read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted((f.getPath().getName() for f in files.listStatus(root) if f.getPath().getName().startswith("v=")),
                      reverse=True)
    for v in versions:
        if files.exists(jvm.org.apache.hadoop.fs.Path(root, f"{v}/_SUCCESS")):
            return spark.read.parquet(f"{base.rstrip('/')}/{v}")
    raise FileNotFoundError(f"no finished version under {base}")


class VersionConflict(RuntimeError):
    """Another writer has made the version first."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    jvm = spark.sparkContext._jvm
    fs, at = _file_system(spark, path)
    try:
        fs.mkdirs(at(path).getParent())
        local = fs.getScheme() == "file"  # whose own create is not exclusive
        if local and not jvm.java.io.File(at(path).toUri().getPath()).createNewFile():
            return False
        stream = fs.create(at(path), local)
    except Py4JJavaError as exc:
        if "AlreadyExists" in exc.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return None
    stream = fs.open(at(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _pointer(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/_versions/{version:010d}"


def current_version(spark: SparkSession, base: str) -> int:
    """Number of the latest finished version, 0 before the first.  Pointers are
    found by their numbers (doubling, then halving), not by listing."""
    low, step = 0, 1
    there = lambda n: bool(_read_small(spark, _pointer(base, n)))
    while there(low + step):
        low, step = low + step, step * 2
    while step > 1:
        step //= 2
        if there(low + step):
            low += step
    return low


def write_version(df: DataFrame, base: str, expected: int | None = None) -> int:
    """A5 for several writers: the rows go to a folder of their own, then a pointer file that
    names the folder's files is created under the next number.  Creating it is the commit: of two
    writers one gets the number, the other a ``VersionConflict`` and may try again on what is
    current then.  ``expected``: the version that the rows were made from."""
    spark = df.sparkSession
    base = base.rstrip("/")
    version = (current_version(spark, base) if expected is None else expected) + 1
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    fs, at = _file_system(spark, base)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(f"{base}/{folder}")) if f.getPath().getName().startswith("part-"))
    text = json.dumps({"files": [f"{folder}/{n}" for n in names], "schema": df.schema.json()})
    if not _create_new(spark, _pointer(base, version), text):
        raise VersionConflict(f"version {version} of {base} is another writer's")
    return version


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version's rows (the current one's by default): exactly the files that its pointer names."""
    version = version or current_version(spark, base)
    text = _read_small(spark, _pointer(base, version)) if version else None
    if not text:
        raise FileNotFoundError(f"no version {version} under {base}")
    found = json.loads(text)
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    if not found["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{base.rstrip('/')}/{f}" for f in found["files"]))


def read_table(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def append_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Schema-merging union for appends with new columns."""
    return existing.unionByName(new, allowMissingColumns=True)
