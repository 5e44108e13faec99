"""Deterministic guideline rules on (gold, candidate) SQL text pairs.

Each rule is a Column expression over the lexical token stream (literals
and comments removed).  ``tokenize`` adds the token arrays once, so a plan
that applies several rules (or the keyword scorer) splits each text once;
the rules themselves avoid lambdas and stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import SEP1, normalised, sql_tokens, strip_to_names

# Lexical, over lower-cased text without literals and comments: names (with the dots and quotes
# between their parts), brackets, commas and statement ends.
_NAME_RE = r"(?:`[^`]*`|[a-z_]\w*)(?:\s*\.\s*(?:`[^`]*`|[a-z_]\w*))*"
_LEXEME_RE = _NAME_RE + r"|[(),;]"
_CTE_RE = rf"(?:\bwith(?:\s+recursive)?|,)\s*({_NAME_RE})\s*(?:\([^()]*\)\s*)?as\s*\("
# words before a bracket that is no call's
_NO_CALLS = ["", "(", ")", ",", ";", "from", "join", "in", "as", "exists", "and", "or", "not", "where", "select", "on", "using", "union",
             "all", "any", "some", "when", "then", "else", "by", "having", "over", "values", "intersect", "except", "minus", "between",
             "is", "like", "with", "lateral", "filter", "distinct", "recursive"]
# words that end a list of tables
_CLAUSES = ["where", "group", "order", "having", "limit", "union", "intersect", "except", "minus", "on", "using", "window", "qualify",
            "cluster", "distribute", "sort", "offset", "fetch", "tablesample", "pivot", "unpivot", ";"]
# words between two tables
_JOINING = ["left", "right", "full", "inner", "outer", "cross", "natural", "semi", "anti", "as"]
# words that can stand where a table does and name none
_NO_TABLES = ["lateral", "unnest", "values", "explode", "table", "only"]

_BLANKS = " \t\n\x0b\f\r"
_NO_WORD = "".join(chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) in "_`"))

SUFFIX = "__tokens"


def tokenize(df: DataFrame, *cols: str, only_first_statement: bool = True) -> DataFrame:
    """Add ``<col>__tokens`` (array of upper-case tokens) for each text column,
    of its first statement or of all."""
    return df.select("*", *[sql_tokens(F.col(c), only_first_statement).alias(c + SUFFIX) for c in cols])


def tokens_of(df: DataFrame, col: str) -> Column:
    """Tokens made by ``tokenize``, else those of the whole text."""
    return F.col(col + SUFFIX) if col + SUFFIX in df.columns else sql_tokens(F.col(col), only_first_statement=False)


def join_count_tokens(tokens: Column) -> Column:
    """Tokens that are JOIN or end in the word JOIN (LEFT JOIN, ...): substring
    counts in the re-joined stream instead of a lambda."""
    s = F.concat(F.lit(SEP1), F.array_join(tokens, SEP1 + SEP1), F.lit(SEP1))
    times = lambda x: (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))) / len(x)
    return (times(SEP1 + "JOIN" + SEP1) + times(" JOIN" + SEP1)).cast("int")


def join_count(sql: Column) -> Column:
    return join_count_tokens(sql_tokens(sql))


def has_select_tokens(tokens: Column) -> Column:
    return F.coalesce(F.array_contains(tokens, "SELECT"), F.lit(False))


def has_select(sql: Column) -> Column:
    return has_select_tokens(sql_tokens(sql))


def tables_used(sql: Column) -> Column:
    """``tables_named`` of a whole text."""
    return tables_named(strip_to_names(sql))


def tables_named(stripped: Column) -> Column:
    """Distinct lower-case names of the tables after FROM (comma lists too) and
    JOIN, minus CTE names, in a text by ``strip_to_names``.

    One pass over the lexemes with a stack of the open brackets: each knows the word
    before it, whether a SELECT stood in it and what was expected outside.  So a FROM in a call
    (``extract(year FROM cast(d AS date))``) names no table however deep it is nested, and a
    list goes on after a sub-query."""
    text = F.lower(stripped)
    bracket = "array<struct<opener:string,select:boolean,outside:int>>"
    # wanted: 0 no table, 1 a table, 2 an alias or the comma before the next table
    state = F.struct(F.array().cast(bracket).alias("open"), F.lit(0).alias("wanted"), F.lit("").alias("last"),
                     F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        opened, wanted, last, found = s["open"], s["wanted"], s["last"], s["found"]
        top = F.try_element_at(opened, F.lit(-1))
        outer = F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))
        to = lambda o, w, f=found: F.struct(o.alias("open"), w.alias("wanted"), t.alias("last"), f.alias("found"))
        no, one, two = F.lit(0), F.lit(1), F.lit(2)
        in_call = F.coalesce(~top["select"] & ~top["opener"].isin(_NO_CALLS), F.lit(False))
        is_call = ~last.isin(_NO_CALLS)
        push = lambda outside: F.array_append(opened, F.struct(
            last.alias("opener"), F.lit(False).alias("select"), outside.alias("outside")))
        selected = F.array_append(outer, F.struct(top["opener"].alias("opener"), F.lit(True).alias("select"), top["outside"].alias("outside")))
        # a name and a bracket are a function that gives a table; after its alias they are column names
        function = (wanted == 2) & (F.try_element_at(found, F.lit(-1)) == last)
        return (F.when((t == "(") & function, to(push(two), no, F.slice(found, 1, F.size(found) - 1)))
                .when(t == "(", to(push(wanted), F.when(is_call, no).otherwise(F.when(wanted == 1, one).otherwise(no))))
                .when(t == ")", to(outer, F.coalesce(F.when(top["outside"] == 1, two).otherwise(top["outside"]), no)))
                .when(t.isin("select", "with"), to(F.when(F.size(opened) > 0, selected).otherwise(opened), no))
                .when(t == "from", to(opened, F.when(in_call | (last == "distinct"), no).otherwise(one)))
                .when(t == "join", to(opened, one))
                .when(t == ",", to(opened, F.when(wanted == 2, one).otherwise(wanted)))
                .when(t.isin(_CLAUSES), to(opened, no))
                .when(t.isin(_JOINING), to(opened, wanted))
                .when((wanted == 1) & ~t.isin(_NO_TABLES), to(opened, two, F.array_append(found, t)))
                .otherwise(to(opened, wanted)))

    plain = lambda names: F.transform(names, lambda x: F.translate(F.regexp_replace(x, r"\s*\.\s*", "."), "`", ""))
    found = F.aggregate(F.regexp_extract_all(text, F.lit(_LEXEME_RE), F.lit(0)), state, step, lambda s: s["found"])
    # the costly pattern only where its end can be found
    ctes = F.when(F.translate(text, _BLANKS, "").contains("as("), F.regexp_extract_all(text, F.lit(_CTE_RE), F.lit(1))).otherwise(
        F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_except(plain(found), plain(ctes))))


def missing_dims(tokens: Column, dims: list[str]) -> Column:
    """Required identifiers absent from the token stream, comma-joined (lower case)."""
    req = F.array(*[F.lit(d.upper()) for d in dims])
    return F.lower(F.array_join(F.array_except(req, tokens), ","))


def rule_count_joins(df: DataFrame, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    return df.withColumn("gold_joins", join_count_tokens(tokens_of(df, gold))).withColumn(
        "cand_joins", join_count_tokens(tokens_of(df, cand))).withColumn(
        "value", F.col("gold_joins") == F.col("cand_joins"))


def rule_has_select(df: DataFrame, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    return df.withColumn("gold_has_select", has_select_tokens(tokens_of(df, gold))).withColumn(
        "cand_has_select", has_select_tokens(tokens_of(df, cand))).withColumn("value", F.col("gold_has_select"))


def rule_tables(df: DataFrame, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    t = df.select("*", tables_used(F.col(gold)).alias("__gt"), tables_used(F.col(cand)).alias("__ct"))
    return (t.withColumn("missing_tables", F.array_join(F.array_except("__gt", "__ct"), ","))
            .withColumn("extra_tables", F.array_join(F.array_except("__ct", "__gt"), ","))
            .withColumn("value", (F.col("missing_tables") == "") & (F.col("extra_tables") == ""))
            .drop("__gt", "__ct"))


def dims_tokens(sql: Column) -> Column:
    """Upper-case words of all statements, those of back-quoted names too."""
    return dims_named(strip_to_names(sql))


def dims_named(stripped: Column) -> Column:
    """``dims_tokens`` of a text by ``strip_to_names``.  Only characters beyond ASCII need a pattern."""
    words = F.translate(stripped, _NO_WORD + "`", " " * len(_NO_WORD))
    words = F.when(F.octet_length(words) == F.length(words), words).otherwise(F.regexp_replace(words, "[^A-Za-z0-9_]+", " "))
    return F.split(F.upper(words), " ")


def rule_required_dims(df: DataFrame, dims: list[str], cand: str = "candidate_sql") -> DataFrame:
    return df.withColumn("missing_dims", missing_dims(dims_tokens(F.col(cand)), dims)).withColumn(
        "value", F.col("missing_dims") == "")


def rule_limit_without_order(df: DataFrame, cols=("gold_sql", "candidate_sql")) -> DataFrame:
    """Flag texts whose result is not deterministic: a LIMIT with no ORDER BY
    anywhere in the (first) statement.  Such pairs should not be scored in
    ordered mode, and a bag verdict on them may flip between runs."""
    out = df
    for c in cols:
        t = tokens_of(df, c)
        out = out.withColumn(f"{c}_unordered_limit",
                             F.array_contains(t, "LIMIT") & ~F.array_contains(t, "ORDER BY"))
    return out


__all__ = ["rule_limit_without_order", "tokenize", "tokens_of", "join_count", "has_select", "tables_used", "tables_named", "dims_tokens", "dims_named", "normalised",
           "rule_count_joins", "rule_has_select", "rule_tables", "rule_required_dims"]
