"""Executed-result equivalence of (gold, candidate) SQL pairs.

Result sets are compared positionally (column names are ignored, gold
results may even carry duplicate names).  The exact comparison is a
*signed union*: gold rows carry +1, candidate rows -1, both sides are
unioned and grouped by every column; groups whose signs do not cancel are
the bag difference.  That is one shuffle with map-side partial sums and no
join, so a hot row value is collapsed before it moves.

``fingerprint`` reduces a result to (row count, order-free 64-bit hash
sum); different fingerprints prove a difference without a shuffle of the
rows.  ``bucket_fingerprints`` do so for each bucket of the hash range, and
``confirm_diff`` sends only rows of buckets that differ through the exact diff.

Ordered mode compares bags of (place, row).  The place is the dense rank by the
keys of the result's own top-level ORDER BY, in its directions, so rows among
ties may stand in any order.  See ``places`` for results without one.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlscore.session import materialize

SIGN = "__sign"
IDX = "__pos"
FEW_KEYS = 10_000     # order keys that are broadcast
PLACE_ROWS = 1 << 18  # rows a task joins with their places

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


# ---------------------------------------------------------------- SQL texts

_ERROR_CLASS = re.compile(r"\[([A-Z][A-Z0-9_]+)(?:\.[A-Z0-9_]+)?\]")

# Leaves of an analysed plan that read nothing from outside it.
_INNER_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
_WITH_PLAN = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
_REFLECTION = {"CallMethodViaReflection", "TryReflect"}


class UnsafeQuery(ValueError):
    """Text is not a single read-only query."""


class TypeMismatch(ValueError):
    """Two columns at the same position have no type in common that keeps every value."""


def wrap_query(text: str | None) -> str:
    """Make a model- or user-written text safe to hand to ``spark.sql``.

    The text is nested as a sub-query, so INSERT / DROP / SET / multi-statement
    texts fail to parse instead of running; CTEs, comments and a top-level
    ORDER BY still work.  What the query may read is checked on its analysed
    plan (``check_plan``), not on the text.
    """
    if text is None or not text.strip():
        raise UnsafeQuery("no_query")
    return f"SELECT * FROM (\n{_body(text)}\n) AS __q"


def _body(text: str) -> str:
    body = text.strip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    return body


def _elements(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(df: DataFrame, views: set[str] | None = None) -> None:
    """Refuse an analysed query that calls methods by reflection or reads
    anything but views (of the names in ``views``, if given): no paths, no
    tables of a catalog.  Nothing is run; a view's own plan is trusted."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier().table()
            if views is not None and name not in views:
                raise UnsafeQuery("forbidden_relation")
            continue
        children = _elements(node.children())
        if not children and kind not in _INNER_LEAVES:
            raise UnsafeQuery("forbidden_relation")
        todo += children
        if kind == "WithCTE":
            todo += _elements(node.cteDefs())
        exprs = _elements(node.expressions())
        while exprs:
            e = exprs.pop()
            kind = e.getClass().getSimpleName()
            if kind in _REFLECTION:
                raise UnsafeQuery("forbidden_construct")
            if kind in _WITH_PLAN:
                todo.append(e.plan())
            exprs += _elements(e.children())


def parse_alone(spark: SparkSession, text: str) -> None:
    """Refuse a text that is no query by itself, whatever it is between the
    brackets it is pasted into (``SELECT 1 AS a) t, (SELECT 2 AS b``)."""
    spark._jsparkSession.sessionState().sqlParser().parseQuery(_body(text))


def run_query(spark: SparkSession, text: str | None, views: set[str] | None = None) -> DataFrame:
    """Analyse a query text (eagerly, on the driver); raises on any error."""
    wrapped = wrap_query(text)
    parse_alone(spark, text)
    df = spark.sql(wrapped)
    check_plan(df, views)
    return df


def classify_error(exc: Exception) -> str:
    msg = str(exc)
    if isinstance(exc, UnsafeQuery):
        return str(exc)
    if isinstance(exc, TypeMismatch):
        return "type_mismatch"
    if "PARSE_SYNTAX_ERROR" in msg or "ParseException" in type(exc).__name__:
        return "not_a_query_or_unparsable"
    if "UNRESOLVED_COLUMN" in msg or "UNRESOLVED_ROUTINE" in msg:
        return "unresolved"
    if "TABLE_OR_VIEW_NOT_FOUND" in msg:
        return "unknown_table"
    m = _ERROR_CLASS.search(msg)  # e.g. [CAST_INVALID_INPUT], [DIVIDE_BY_ZERO]
    return m.group(1).lower() if m else "error"


# ---------------------------------------------------------- normalisation

def positional(df: DataFrame) -> DataFrame:
    """Rename columns to _c0.._cn so duplicate or differing names do not matter."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    return isinstance(dt, T.MapType)


def _comparable(c: Column, dt: T.DataType) -> tuple[Column, T.DataType]:
    """Maps cannot be grouped or hashed: turn them, at any depth, into sorted entry arrays."""
    if not _has_map(dt):
        return c, dt
    if isinstance(dt, T.ArrayType):
        inner = _comparable_type(dt.elementType)
        return F.transform(c, lambda x: _comparable(x, dt.elementType)[0]), T.ArrayType(inner)
    if isinstance(dt, T.StructType):
        fields = [_comparable(c[f.name], f.dataType)[0].alias(f.name) for f in dt.fields]
        return F.when(c.isNotNull(), F.struct(*fields)), _comparable_type(dt)
    entries = F.transform(F.map_entries(c), lambda e: F.struct(
        _comparable(e["key"], dt.keyType)[0].alias("key"), _comparable(e["value"], dt.valueType)[0].alias("value")))
    return F.array_sort(entries), _comparable_type(dt)


def _comparable_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_comparable_type(dt.elementType))
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _comparable_type(f.dataType)) for f in dt.fields])
    if isinstance(dt, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("key", _comparable_type(dt.keyType)),
                                         T.StructField("value", _comparable_type(dt.valueType))]))
    return dt


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}  # decimal digits of integral types


def _split_type(scale: int) -> T.StructType:
    """Sign, whole part and fraction of a number, where 38 digits don't hold both parts."""
    return T.StructType([T.StructField("negative", T.BooleanType()), T.StructField("whole", T.DecimalType(38, 0)),
                         T.StructField("fraction", T.DecimalType(38, scale))])


def _is_split(dt: T.DataType) -> bool:
    return isinstance(dt, T.StructType) and dt.names == ["negative", "whole", "fraction"]


def _to_type(c: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """The column in the common type; whole part and fraction are exact for every decimal."""
    if given == wanted:
        return c
    if not (_is_split(wanted) and isinstance(given, _INTEGRAL + (T.DecimalType,))):
        return c.cast(wanted)
    scale = given.scale if isinstance(given, T.DecimalType) else 0
    size = F.abs(c if scale or isinstance(given, T.DecimalType) else c.cast(T.DecimalType(19, 0)))
    fraction = size % F.lit(1).cast(T.DecimalType(1, 0)) if scale < 38 else size  # DECIMAL(38,38) has no whole part
    fields = wanted.fields
    return F.when(c.isNotNull(), F.struct(
        (c < 0).alias("negative"), F.floor(size).cast(fields[1].dataType).alias("whole"),
        fraction.cast(fields[2].dataType).alias("fraction")))


def common_type(a: T.DataType, b: T.DataType, strict: bool = False) -> T.DataType | None:
    """The type both columns are compared in.  Exact numbers widen exactly, decimals
    too wide for one type to sign, whole part and fraction; only where a side is a
    float is it DOUBLE.  None: no such type (or ``strict``)."""
    if a == b:
        return a
    if strict:
        return None
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, _INTEGRAL) and isinstance(b, _INTEGRAL):
        return T.LongType()
    if isinstance(a, _INTEGRAL + _FRACTIONAL) and isinstance(b, _INTEGRAL + _FRACTIONAL):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        (wa, sa), (wb, sb) = ((x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType)
                              else (_DIGITS[type(x)], 0) for x in (a, b))
        whole, scale = max(wa, wb), max(sa, sb)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else _split_type(scale)
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType()
    if isinstance(a, T.StringType) and isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return inner and not _is_split(inner) and T.ArrayType(inner) or None
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and len(a.fields) == len(b.fields):
        inner = [common_type(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields)]
        if all(inner) and not any(map(_is_split, inner)):
            return T.StructType([T.StructField(f.name, t) for f, t in zip(a.fields, inner)])
    return None


def _aligned(gold: DataFrame, cand: DataFrame, strict_types: bool = False):
    """(gold_src, gold_exprs, cand_src, cand_exprs) producing _c0.._cn with one
    common type per position, or None if widths (or strict types) differ.
    Columns are renamed through ``toDF`` only when a side has duplicate names;
    otherwise the casts and renames are one projection per side, which keeps
    the number of analysed plans per pair small."""
    if len(gold.columns) != len(cand.columns):
        return None

    def src(df):
        names = df.columns
        if len(set(names)) == len(names):
            return df, [F.col(f"`{n}`") for n in names]
        p = positional(df)
        return p, [F.col(n) for n in p.columns]

    gsrc, gin = src(gold)
    csrc, cin = src(cand)
    gexprs, cexprs = [], []
    for i, (gc, cc, gf, cf) in enumerate(zip(gin, cin, gold.schema.fields, cand.schema.fields)):
        gcol, gdt = _comparable(gc, gf.dataType)
        ccol, cdt = _comparable(cc, cf.dataType)
        dt = common_type(gdt, cdt, strict_types)
        if dt is None and strict_types:  # never equal
            return None
        if dt is None:
            raise TypeMismatch(f"column {i}: {gdt.simpleString()} and {cdt.simpleString()}")
        gexprs.append(_to_type(gcol, gdt, dt).alias(f"_c{i}"))
        cexprs.append(_to_type(ccol, cdt, dt).alias(f"_c{i}"))
    return gsrc, gexprs, csrc, cexprs


def align(gold: DataFrame, cand: DataFrame, strict_types: bool = False):
    """Positional columns with one common type per position (None if widths differ)."""
    a = _aligned(gold, cand, strict_types)
    if a is None:
        return None
    gsrc, gexprs, csrc, cexprs = a
    return gsrc.select(*gexprs), csrc.select(*cexprs)


# ------------------------------------------------------------ exact diff

def dense_index(df: DataFrame, name: str = IDX) -> DataFrame:
    """0-based position of each row in the DataFrame's current order.

    Distributed zip-with-index: per-partition row counts (one row per
    partition, a proven small size) give offsets that are broadcast back.
    No single-partition window.  The input is materialised first (reliable
    checkpoint in the shared folder): the counts and the rows must see the
    very same partitions, which two independent reads of a shuffle with
    adaptive coalescing do not promise, and the input is computed once.
    """
    tagged = materialize(df).select("*", F.spark_partition_id().alias("__pid"),
                                    F.monotonically_increasing_id().alias("__mid"))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__base"))
    # over one row per partition: a proven small input
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("__pid", "__base", "__off")), "__pid")
            .withColumn(name, F.col("__off") + F.col("__mid") - F.col("__base"))
            .drop("__pid", "__mid", "__base", "__off"))


@dataclass(frozen=True)
class Order:
    """What a result is ordered by: ``keys`` as (column number, ascending, nulls
    first), or no keys where it is ordered by something that is no column of it."""
    keys: tuple[tuple[int, bool, bool], ...] = ()


def sort_order(df: DataFrame) -> Order | None:
    """The order that a query asks for with its top-level ORDER BY, from the
    analysed plan; None if it asks for none.  An ORDER BY in a sub-query is none."""
    plan = df._jdf.queryExecution().analyzed()
    ids = [a.exprId().id() for a in _elements(plan.output())]
    while (kind := plan.getClass().getSimpleName()) != "Sort":
        if kind == "Project":
            named = {}
            for e in _elements(plan.projectList()):
                if e.getClass().getSimpleName() == "Alias" and e.child().getClass().getSimpleName() == "AttributeReference":
                    named[e.exprId().id()] = e.child().exprId().id()
            ids = [named.get(i, i) for i in ids]
        elif kind == "WithCTE":
            plan = plan.plan()
            continue
        elif kind not in ("GlobalLimit", "LocalLimit", "Offset") and not (kind == "SubqueryAlias" and plan.alias() == "__q"):
            return None
        plan = plan.child()
    keys = []
    for o in _elements(plan.order()):
        by = o.child()
        if by.getClass().getSimpleName() != "AttributeReference" or by.exprId().id() not in ids:
            return Order()
        keys.append((ids.index(by.exprId().id()), o.direction().sql() == "ASC", o.nullOrdering().sql() == "NULLS FIRST"))
    return Order(tuple(keys))


def orders_of(gold: DataFrame, cand: DataFrame, order_key: str | None = None) -> tuple[Order | None, Order | None]:
    """The orders two results are compared in.  ``order_key`` (``_c0``, ...) sets an
    ascending one for both.  A candidate that is ordered by the gold's keys and further
    ones only settles the gold's ties, so it is compared by the gold's."""
    if order_key is not None:
        own = Order(((int(order_key.removeprefix("_c")), True, True),))
        return own, own
    g, c = sort_order(gold), sort_order(cand)
    if g is None:
        return None, None
    if c is not None and g.keys and c.keys[:len(g.keys)] == g.keys:
        c = g
    return g, c


def places(df: DataFrame, order: Order | None) -> DataFrame:
    """Add each row's place: the dense rank by the order's keys.  Without an order
    all rows share a place (one big tie); by something that is no column it is the
    row's position in the result.

    Ranks are found for the distinct keys only, by a range-partitioned sort, and
    come back by a join on the keys, in as many partitions as the counted rows need."""
    if order is None:
        return df.withColumn(IDX, F.lit(0).cast("long"))
    if not order.keys:
        return dense_index(df)
    names = [f"_c{i}" for i in dict.fromkeys(i for i, _, _ in order.keys)]
    by = []
    for i, up, nulls_first in order.keys:
        c = F.col(f"_c{i}")
        by.append((c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if up
                  else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()))
    ranks = dense_index(df.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows")).orderBy(*by))
    ranks = ranks.select(*(F.col(n).alias(f"__k{n}") for n in names), "__rows", IDX)
    return _join_ranks(df, ranks, names).select(*(f"`{c}`" for c in df.columns), IDX)


def _join_ranks(df: DataFrame, ranks: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the rank of their key.  Few keys are broadcast, and so are those with more
    rows than a task is to take; the others are dealt out by a hash of the key to tasks of
    about ``PLACE_ROWS`` rows, however large the result is."""
    same = functools.reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__k{n}")) for n in names])
    keys, rows, hot = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0)),
                                F.count_if(F.col("__rows") > PLACE_ROWS)).first()
    if keys <= FEW_KEYS:
        return df.join(F.broadcast(ranks), same)
    if not all(isinstance(t, _SIMPLE) and "collate" not in t.simpleString() for t in (df.schema[n].dataType for n in names)):
        return df.join(ranks, same)  # equal keys may have other hashes
    parts = rows // PLACE_ROWS + 1
    often = F.broadcast(ranks.filter(F.col("__rows") > PLACE_ROWS))  # fewer than there are parts
    rest = df.join(often, same, "left_anti") if hot else df
    # no equality but that of the hash, so that the join takes the partitions as they are dealt
    alike = functools.reduce(Column.__and__, [
        ((F.col(n) <= F.col(f"__k{n}")) & (F.col(n) >= F.col(f"__k{n}"))) | (F.col(n).isNull() & F.col(f"__k{n}").isNull())
        for n in names])
    dealt = rest.withColumn("__h", F.xxhash64(*names)).repartition(parts, "__h")
    own = ranks.filter(F.col("__rows") <= PLACE_ROWS).withColumn("__kh", F.xxhash64(*(f"__k{n}" for n in names))).repartition(parts, "__kh")
    found = dealt.join(own, (F.col("__h") == F.col("__kh")) & alike).drop("__h", "__kh")
    return df.join(often, same).unionByName(found) if hot else found


Orders = tuple[Order | None, Order | None]


def _by_mode(gold: DataFrame, cand: DataFrame, mode: str, orders: Orders | None):
    """Both sides and the columns that make up a row in ``mode``."""
    if mode == "set":
        gold, cand = gold.distinct(), cand.distinct()
    elif mode == "ordered":
        if orders is None:
            raise ValueError("ordered mode needs the orders of both results")
        gold, cand = places(gold, orders[0]), places(cand, orders[1])
    elif mode != "bag":
        raise ValueError(f"unknown mode {mode!r}")
    return gold, cand, list(gold.columns)


def _signed(gold: DataFrame, cand: DataFrame, mode: str, orders: Orders | None) -> tuple[DataFrame, list[str]]:
    """All rows of both sides with their sign, and the columns that make up a row."""
    gold, cand, cols = _by_mode(gold, cand, mode, orders)
    return gold.select(*cols, F.lit(1).alias(SIGN)).union(cand.select(*cols, F.lit(-1).alias(SIGN))), cols


def signed_diff(gold: DataFrame, cand: DataFrame, mode: str = "bag", orders: Orders | None = None) -> DataFrame:
    """Rows whose multiplicity differs: columns _c*, ``n`` (>0 gold has more)
    and ``side``.  Inputs must already be aligned (same width and types).

    mode: ``bag`` (duplicates count), ``set`` (distinct rows), ``ordered`` (a row's
    place is part of it; ``orders`` from ``orders_of`` the results before alignment)."""
    both, cols = _signed(gold, cand, mode, orders)
    return (both.groupBy(*cols).agg(F.sum(SIGN).alias("n"))
            .filter(F.col("n") != 0)
            .withColumn("side", F.when(F.col("n") > 0, F.lit("gold")).otherwise(F.lit("candidate"))))


def diff_counts(gold: DataFrame, cand: DataFrame, mode: str = "bag", orders: Orders | None = None) -> DataFrame:
    """One row: gold_rows, cand_rows, only_in_gold, only_in_candidate.

    Counts ride along the same grouping as the diff, so a pair costs one shuffle.
    """
    return _count_columns(*_signed(gold, cand, mode, orders))


def _count_columns(both: DataFrame, cols: list[str]) -> DataFrame:
    """Signed rows grouped by every column -> one row of counts.  Partial sums
    collapse repeated rows on the map side before the shuffle."""
    return _counts(_grouped(both, cols))


def _grouped(both: DataFrame, cols: list[str]) -> DataFrame:
    return both.groupBy(*cols).agg(F.sum(SIGN).alias("n"), F.count_if(F.col(SIGN) > 0).alias("g"),
                                   F.count_if(F.col(SIGN) < 0).alias("c"))


def _counts(grouped: DataFrame) -> DataFrame:
    return grouped.agg(
        F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("gold_rows"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("cand_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("long").alias("only_in_gold"),
        F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).cast("long").alias("only_in_candidate"))


def results_equal(gold: DataFrame, cand: DataFrame, mode: str = "bag",
                  strict_types: bool = False, order_key: str | None = None) -> DataFrame:
    """Verdict row for two result DataFrames (lazy, one row):
    gold_rows, cand_rows, only_in_gold, only_in_candidate, value."""
    a = _aligned(gold, cand, strict_types)
    if a is None:  # widths differ: every row differs
        counts = _side_counts(gold.agg(F.count(F.lit(1)).alias("n")), cand.agg(F.count(F.lit(1)).alias("n")))
        counts = counts.select(F.col("g_n").alias("gold_rows"), F.col("c_n").alias("cand_rows"),
                               F.col("g_n").alias("only_in_gold"), F.col("c_n").alias("only_in_candidate"))
    elif mode == "bag":  # fast path: casts, renames and the sign in one projection per side
        gsrc, gexprs, csrc, cexprs = a
        both = gsrc.select(*gexprs, F.lit(1).alias(SIGN)).union(csrc.select(*cexprs, F.lit(-1).alias(SIGN)))
        counts = _count_columns(both, [f"_c{i}" for i in range(len(gexprs))])
    else:
        orders = orders_of(gold, cand, order_key) if mode == "ordered" else None
        counts = diff_counts(*align(gold, cand, strict_types), mode=mode, orders=orders)
    return counts.select("*", ((F.col("only_in_gold") == 0) & (F.col("only_in_candidate") == 0)).alias("value"))


def _side_counts(g: DataFrame, c: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side (g_*, c_*) without a join."""
    cols = g.columns
    both = g.select("*", F.lit(1).alias(SIGN)).union(c.select(*cols, F.lit(-1).alias(SIGN)))
    return both.agg(*[F.max(F.when(F.col(SIGN) > 0, F.col(x))).alias(f"g_{x}") for x in cols],
                    *[F.max(F.when(F.col(SIGN) < 0, F.col(x))).alias(f"c_{x}") for x in cols])


def diff_sample(gold: DataFrame, cand: DataFrame, k: int = 5, mode: str = "bag",
                order_key: str | None = None) -> DataFrame:
    """At most ``k`` differing rows per side (ordered by the row values), taken
    from the diff only — never from the whole results."""
    pair = align(gold, cand)
    if pair is None:
        raise ValueError("results have different widths")
    d = signed_diff(*pair, mode=mode, orders=orders_of(gold, cand, order_key) if mode == "ordered" else None)
    cols = [c for c in d.columns if c.startswith("_c") or c == IDX]
    parts = [d.filter(F.col("side") == s).orderBy(*cols).limit(k) for s in ("gold", "candidate")]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------ fingerprint

def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; null flags keep (1,NULL) and (NULL,1) apart,
    -0.0 is folded into 0.0."""
    parts = []
    for f in df.schema.fields:
        c, dt = _comparable(F.col(f"`{f.name}`"), f.dataType)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            c = F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
        parts += [c.isNull(), c]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, hash_sum (order-free; sum as decimal so ANSI never overflows)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(row_hash(df).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
                  .alias("hash_sum"))


def bucket_fingerprints(gold: DataFrame, cand: DataFrame, buckets: int = 1024) -> DataFrame:
    """Buckets of the row hash in which two aligned results differ: ``bucket`` and
    ``rows``, the number of rows of both sides in it.  Each task sends at most one
    row a bucket.  Sums of 64-bit hashes: unequal sums prove a difference."""
    sides = []
    for df, sign in ((gold, 1), (cand, -1)):
        h = row_hash(df)
        sides.append(df.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.lit(sign).alias(SIGN),
                               (h.cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias("h")))
    sums = sides[0].union(sides[1]).groupBy("bucket").agg(
        F.sum(SIGN).alias("n"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("rows"))
    return sums.filter((F.col("n") != 0) | (F.col("h") != 0)).select("bucket", "rows")


def confirm_diff(gold: DataFrame, cand: DataFrame, buckets: int = 1024) -> DataFrame:
    """The exact bag difference (as ``signed_diff``) of two results that are mostly
    equal: only rows of buckets with unequal fingerprints are shuffled.  Choose
    ``buckets`` well above the number of rows expected to differ."""
    pair = align(gold, cand)
    if pair is None:
        raise ValueError("results have different widths")
    unequal = F.broadcast(bucket_fingerprints(*pair, buckets).select("bucket"))  # at most ``buckets`` rows
    own = "__bucket"
    sides = [df.withColumn(own, F.pmod(row_hash(df), F.lit(buckets)).cast("int"))
             .join(unequal, F.col(own) == F.col("bucket"), "left_semi").drop(own) for df in pair]
    return signed_diff(*sides)


# ------------------------------------------------------------ pair scoring

@dataclass
class Pair:
    pair_id: str
    gold_sql: str | None
    cand_sql: str | None


VERDICT_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("gold_rows", T.LongType()),
    T.StructField("cand_rows", T.LongType()),
    T.StructField("only_in_gold", T.LongType()),
    T.StructField("only_in_candidate", T.LongType()),
    T.StructField("value", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


_VERDICT = Row(*VERDICT_SCHEMA.fieldNames())
REPORT_SCHEMA = T.StructType([*VERDICT_SCHEMA.fields, T.StructField("side", T.StringType()), T.StructField("row", T.StringType())])
_SIMPLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _verdict_sql(pair: Pair, gold: DataFrame, cand: DataFrame, strict_types: bool, samples: int | None = None) -> str | None:
    """One statement computing a bag verdict for two analysed texts, or None
    when the DataFrame path is needed (widths or strict types differ, or a
    column is not of an atomic or map-of-atomic type).  Composing the pair as
    one SQL statement costs one analysis instead of one per API call.

    With ``samples`` the statement also gives that many differing rows a side
    (``REPORT_SCHEMA``); they read the very grouping that is counted, whose shuffle
    Spark runs once."""
    gf, cf = gold.schema.fields, cand.schema.fields
    if len(gf) != len(cf):
        return None
    gsel, csel = [], []
    for i, (a, b) in enumerate(zip(gf, cf)):
        exprs = []
        for f in (a, b):
            if isinstance(f.dataType, _SIMPLE):
                exprs.append((f"c{i}", f.dataType))
            elif (isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, _SIMPLE)
                  and isinstance(f.dataType.valueType, _SIMPLE)):
                exprs.append((f"array_sort(map_entries(c{i}))", _comparable_type(f.dataType)))
            else:
                return None
        (ge, gdt), (ce, cdt) = exprs
        dt = common_type(gdt, cdt, strict_types)
        if dt is None or _is_split(dt):  # the DataFrame path splits, or tells why not
            return None
        gsel.append(ge if gdt == dt else f"CAST({ge} AS {dt.simpleString()})")
        csel.append(ce if cdt == dt else f"CAST({ce} AS {dt.simpleString()})")
    cols = ", ".join(f"c{i}" for i in range(len(gf)))
    keys = ", ".join(f"_c{i}" for i in range(len(gf)))
    pid = pair.pair_id.replace("'", "''")
    gs = ", ".join(f"{e} AS _c{i}" for i, e in enumerate(gsel))
    cs = ", ".join(f"{e} AS _c{i}" for i, e in enumerate(csel))
    more, tail = "", ""
    if samples is not None:
        cells = ", ".join(f"'_c{i}', _c{i}" for i in range(len(gf)))
        none = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in VERDICT_SCHEMA.fields[1:])
        more = ", CAST(NULL AS STRING) AS side, CAST(NULL AS STRING) AS row"
        tail = "".join(f"""
UNION ALL SELECT '{pid}', {none}, '{side}', to_json(named_struct({cells}))
FROM (SELECT * FROM grp WHERE n {sign} 0 AND g + c > 0 ORDER BY {keys} LIMIT {samples})"""
                       for side, sign in (("gold", ">"), ("candidate", "<")))
    return f"""WITH g AS (SELECT * FROM (
{_body(pair.gold_sql)}
) AS __g({cols})), c AS (SELECT * FROM (
{_body(pair.cand_sql)}
) AS __c({cols})),
s AS (SELECT {gs}, 1 AS {SIGN} FROM g UNION ALL SELECT {cs}, -1 AS {SIGN} FROM c),
grp AS (SELECT {keys}, sum({SIGN}) AS n, count_if({SIGN} > 0) AS g, count_if({SIGN} < 0) AS c FROM s GROUP BY {keys}),
tot AS (SELECT CAST(coalesce(sum(g), 0) AS BIGINT) AS gold_rows, CAST(coalesce(sum(c), 0) AS BIGINT) AS cand_rows,
  CAST(coalesce(sum(CASE WHEN n > 0 THEN n END), 0) AS BIGINT) AS only_in_gold,
  CAST(coalesce(sum(CASE WHEN n < 0 THEN -n END), 0) AS BIGINT) AS only_in_candidate FROM grp)
SELECT '{pid}' AS pair_id, gold_rows, cand_rows, only_in_gold, only_in_candidate,
  (only_in_gold = 0 AND only_in_candidate = 0) AS value, CAST(NULL AS STRING) AS error{more} FROM tot{tail}"""


def pair_verdict(spark: SparkSession, pair: Pair, mode: str = "bag", strict_types: bool = False,
                 order_key: str | None = None, views: set[str] | None = None) -> DataFrame:
    """Lazy one-row verdict for a pair; analysis errors become ``error`` rows."""
    return _pair(spark, pair, mode, strict_types, order_key, views, None)


def pair_report(spark: SparkSession, pair: Pair, mode: str = "bag", strict_types: bool = False,
                order_key: str | None = None, views: set[str] | None = None, samples: int = 5) -> DataFrame:
    """The verdict row of a pair and, in the same plan, up to ``samples`` differing
    rows a side as JSON texts (rows of ``REPORT_SCHEMA`` with a ``side``)."""
    return _pair(spark, pair, mode, strict_types, order_key, views, samples)


def _pair(spark: SparkSession, pair: Pair, mode: str, strict_types: bool, order_key: str | None,
          views: set[str] | None, samples: int | None) -> DataFrame:
    side = "gold:"
    try:
        if pair.gold_sql is None:
            raise UnsafeQuery("no_gold")
        gold = run_query(spark, pair.gold_sql, views)
        side = "candidate:"
        cand = run_query(spark, pair.cand_sql, views)
        side = ""  # from here on it is about both
        sql = _verdict_sql(pair, gold, cand, strict_types, samples) if mode == "bag" else None
        if sql is not None:
            return spark.sql(sql)
        head = [F.lit(pair.pair_id).alias("pair_id"), "gold_rows", "cand_rows", "only_in_gold", "only_in_candidate",
                "value", F.lit(None).cast("string").alias("error")]
        if samples is None:
            v = results_equal(gold, cand, mode=mode, strict_types=strict_types, order_key=order_key)
            return v.select(*head)
        return _report(pair, gold, cand, mode, strict_types, order_key, samples, head)
    except Exception as exc:  # noqa: BLE001 - any failure is a verdict
        return _error_row(spark, pair.pair_id, side + classify_error(exc), VERDICT_SCHEMA if samples is None else REPORT_SCHEMA)


def _report(pair: Pair, gold: DataFrame, cand: DataFrame, mode: str, strict_types: bool, order_key: str | None,
            samples: int, head: list) -> DataFrame:
    """``pair_report`` by the DataFrame API, from one grouping."""
    if (aligned := align(gold, cand, strict_types)) is None:
        counts = results_equal(gold, cand, strict_types=strict_types)
        some = [(side, positional(df).limit(samples).select(F.to_json(F.struct("*")).alias("row")))
                for side, df in (("gold", gold), ("candidate", cand))]
    else:
        both, cols = _signed(*aligned, mode, orders_of(gold, cand, order_key) if mode == "ordered" else None)
        grouped = _grouped(both, cols)
        counts = _counts(grouped).select("*", ((F.col("only_in_gold") == 0) & (F.col("only_in_candidate") == 0)).alias("value"))
        cells = F.struct(*([F.col(IDX).alias("place")] if IDX in cols else []), *(F.col(c) for c in cols if c != IDX))
        seen = (F.col("g") + F.col("c") > 0)  # keeps the grouping as it is counted, so that its shuffle is shared
        first = [IDX] * (IDX in cols) + [c for c in cols if c != IDX]
        some = [(side, grouped.filter(which & seen).orderBy(*first).limit(samples).select(F.to_json(cells).alias("row")))
                for side, which in (("gold", F.col("n") > 0), ("candidate", F.col("n") < 0))]
    out = counts.select(*head, F.lit(None).cast("string").alias("side"), F.lit(None).cast("string").alias("row"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in VERDICT_SCHEMA.fields[1:]]
    for side, rows in some:
        out = out.union(rows.select(F.lit(pair.pair_id).alias("pair_id"), *none, F.lit(side).alias("side"), "row"))
    return out


def _error_row(spark: SparkSession, pair_id: str, error: str, schema: T.StructType = VERDICT_SCHEMA) -> DataFrame:
    row = (pair_id, None, None, None, None, False, error)
    return spark.createDataFrame([row + (None,) * (len(schema) - len(row))], schema)


def verdicts(spark: SparkSession, pairs: list[Pair], mode: str = "bag", strict_types: bool = False,
             order_key: str | None = None, views: set[str] | None = None) -> DataFrame:
    """All pair verdicts as one lazy DataFrame (one job when collected)."""
    parts = [pair_verdict(spark, p, mode, strict_types, order_key, views) for p in pairs]
    if not parts:
        return spark.createDataFrame([], VERDICT_SCHEMA)
    return functools.reduce(DataFrame.union, parts)  # same column order in every part


def _in_groups(pairs: list[Pair], group_size: int, plan, failed) -> list[Row]:
    """Rows of ``plan(pair)`` for all pairs, so many plans a job; a runtime error in a
    group runs that group again pair by pair, so that one bad query cannot fail its neighbours."""
    rows = []
    for i in range(0, len(pairs), group_size):
        group = pairs[i:i + group_size]
        try:
            rows += functools.reduce(DataFrame.union, [plan(p) for p in group]).collect()
        except Exception:  # noqa: BLE001 - fall back to singles
            for p in group:
                try:
                    rows += plan(p).collect()
                except Exception as exc:  # noqa: BLE001
                    rows.append(failed(p, "runtime:" + classify_error(exc)))
    return rows


def score_pairs(spark: SparkSession, pairs: list[Pair], mode: str = "bag", group_size: int = 50,
                strict_types: bool = False, order_key: str | None = None, views: set[str] | None = None) -> list[Row]:
    """Verdict rows of ``pairs``, executed in groups of ``group_size`` plans per
    job.  One small row per given pair."""
    return _in_groups(pairs, group_size, lambda p: pair_verdict(spark, p, mode, strict_types, order_key, views),
                      lambda p, error: _VERDICT(p.pair_id, None, None, None, None, False, error))


VERDICT_TEXT = T.StructType([*VERDICT_SCHEMA.fields, T.StructField("rationale", T.StringType()),
                             T.StructField("sample_gold", T.ArrayType(T.StringType())),
                             T.StructField("sample_candidate", T.ArrayType(T.StringType()))])


def report_pairs(spark: SparkSession, pairs: list[Pair], samples: int = 5, mode: str = "bag", group_size: int = 50,
                 strict_types: bool = False, order_key: str | None = None, views: set[str] | None = None) -> list[tuple]:
    """Rows of ``VERDICT_TEXT``: verdicts with a sentence that says why, and sample rows
    where results differ.  A group's verdicts and samples are one job."""
    report = Row(*REPORT_SCHEMA.fieldNames())

    def failed(p: Pair, error: str) -> Row:
        # a plan of several branches fails in several stages at once; the verdict alone says why
        v = score_pairs(spark, [p], mode, 1, strict_types, order_key, views)[0]
        return report(p.pair_id, None, None, None, None, False, v["error"] or error, None, None)

    found = _in_groups(pairs, group_size, lambda p: pair_report(spark, p, mode, strict_types, order_key, views, samples), failed)
    some: dict[tuple[str, str], list[str]] = {}
    for r in found:
        if r["side"]:
            some.setdefault((r["pair_id"], r["side"]), []).append(r["row"])
    out = []
    for r in found:
        if r["side"]:
            continue
        pair_id, g, c, only_g, only_c, value, error = tuple(r)[:7]
        if error:
            why = f"Not compared: {error}."
        elif value:
            why = f"Both queries return the same {g} rows."
        else:
            why = f"{only_g} of {g} gold rows and {only_c} of {c} candidate rows have no partner."
        out.append((pair_id, g, c, only_g, only_c, value, error, why,
                    some.get((pair_id, "gold"), []), some.get((pair_id, "candidate"), [])))
    return out


def _fingerprint_sql(pair: Pair, gold: DataFrame, cand: DataFrame) -> str | None:
    """One statement with both fingerprints of a pair (same rules as
    ``row_hash``: null flags, -0.0 folded, maps as sorted entries), or None."""
    gf, cf = gold.schema.fields, cand.schema.fields
    if len(gf) != len(cf):
        return None
    parts = {"g": [], "c": []}
    for i, (a, b) in enumerate(zip(gf, cf)):
        if any(isinstance(f.dataType, (T.ArrayType, T.StructType)) or _has_map(f.dataType) and not (
                isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, _SIMPLE)
                and isinstance(f.dataType.valueType, _SIMPLE)) for f in (a, b)):
            return None
        dt = common_type(_comparable_type(a.dataType), _comparable_type(b.dataType))
        if dt is None or _is_split(dt):
            return None
        for side, f in (("g", a), ("c", b)):
            e = f"array_sort(map_entries(c{i}))" if isinstance(f.dataType, T.MapType) else f"c{i}"
            if _comparable_type(f.dataType) != dt:
                e = f"CAST({e} AS {dt.simpleString()})"
            if isinstance(dt, (T.FloatType, T.DoubleType)):
                e = f"CASE WHEN {e} = 0 THEN CAST(0.0 AS {dt.simpleString()}) ELSE {e} END"
            parts[side].append((e, dt))
    cols = ", ".join(f"c{i}" for i in range(len(gf)))

    def h(side):
        return "xxhash64(" + ", ".join(f"({e}) IS NULL, {e}" for e, _ in parts[side]) + ")"

    pid = pair.pair_id.replace("'", "''")
    return f"""WITH g AS (SELECT * FROM (
{_body(pair.gold_sql)}
) AS __g({cols})), c AS (SELECT * FROM (
{_body(pair.cand_sql)}
) AS __c({cols})),
f AS (SELECT 1 AS side, count(1) AS r, coalesce(sum(CAST({h("g")} AS DECIMAL(38,0))), 0) AS hs FROM g
      UNION ALL SELECT -1 AS side, count(1) AS r, coalesce(sum(CAST({h("c")} AS DECIMAL(38,0))), 0) AS hs FROM c),
w AS (SELECT max(CASE WHEN side = 1 THEN r END) AS gr, max(CASE WHEN side = -1 THEN r END) AS cr,
             max(CASE WHEN side = 1 THEN hs END) AS gh, max(CASE WHEN side = -1 THEN hs END) AS ch FROM f)
SELECT '{pid}' AS pair_id, gr AS gold_rows, cr AS cand_rows, (gr = cr AND gh = ch) AS fp_match FROM w"""


def fingerprint_verdicts(spark: SparkSession, pairs: list[Pair]) -> DataFrame:
    """Per pair: gold/candidate fingerprints and whether they match (no row
    shuffle: each side is one partial+final aggregate).  Each text is analysed
    once; texts that fail analysis give (NULL, NULL, false)."""
    parts = []
    for p in pairs:
        try:
            gold, cand = run_query(spark, p.gold_sql), run_query(spark, p.cand_sql)
            sql = _fingerprint_sql(p, gold, cand)
            if sql is not None:
                parts.append(spark.sql(sql))
                continue
            pg = align(gold, cand)
            g, c = (fingerprint(gold), fingerprint(cand)) if pg is None else (fingerprint(pg[0]), fingerprint(pg[1]))
            row = _side_counts(g, c).select(
                F.lit(p.pair_id).alias("pair_id"), F.col("g_rows").alias("gold_rows"),
                F.col("c_rows").alias("cand_rows"),
                ((F.col("g_rows") == F.col("c_rows")) & (F.col("g_hash_sum") == F.col("c_hash_sum"))
                 & F.lit(pg is not None)).alias("fp_match"))
        except Exception:  # noqa: BLE001
            row = spark.createDataFrame([(p.pair_id, None, None, False)],
                                        "pair_id string, gold_rows long, cand_rows long, fp_match boolean")
        parts.append(row)
    return functools.reduce(DataFrame.union, parts)
