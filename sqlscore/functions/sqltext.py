"""Column functions over SQL and prompt texts (all JVM-side, no UDFs).

The SQL keyword tokenizer is lexical, not a parser.  String literals,
quoted names and comments are blanked in one left-to-right regex pass
(whichever construct opens first wins, as in a lexer), the text is cut at
the first ``;`` (first statement only), every run of separator characters
(ASCII non-word characters and Unicode blanks) becomes a double separator,
the text is upper-cased, multi-word keywords are fused by literal replaces,
and tokens come from a one-character split (Java's non-regex fast path).  No lambdas, so the whole chain stays in
generated code.  The same steps run in DuckDB for the oracle; no
look-around, no back-references, ASCII classes only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword lexicon (single words), alphabetical.
KEYWORDS = [
    "ALL", "ALTER", "AND", "ANTI", "ANY", "ARRAY", "AS", "ASC", "BETWEEN", "BOTH", "BY", "CASE", "CAST",
    "COLLATE", "CREATE", "CROSS", "CUBE", "CURRENT", "CURRENT_DATE", "CURRENT_TIMESTAMP", "DATE", "DELETE",
    "DESC", "DISTINCT", "DROP", "ELSE", "END", "ESCAPE", "EXCEPT", "EXISTS", "EXPLAIN", "FALSE", "FETCH",
    "FILTER", "FIRST", "FOLLOWING", "FOR", "FROM", "FULL", "GROUP", "GROUPING", "HAVING", "ILIKE", "IN",
    "INNER", "INSERT", "INTERSECT", "INTERVAL", "INTO", "IS", "JOIN", "LAST", "LATERAL", "LEFT", "LIKE",
    "LIMIT", "MERGE", "MINUS", "NATURAL", "NOT", "NULL", "NULLS", "OFFSET", "ON", "OR", "ORDER", "OUTER",
    "OVER", "PARTITION", "PRECEDING", "QUALIFY", "RANGE", "RECURSIVE", "RIGHT", "RLIKE", "ROLLUP", "ROW",
    "ROWS", "SELECT", "SEMI", "SET", "SOME", "TABLE", "TABLESAMPLE", "THEN", "TIMESTAMP", "TO", "TRUE",
    "TRUNCATE", "UNBOUNDED", "UNION", "UPDATE", "USING", "VALUES", "VIEW", "WHEN", "WHERE", "WINDOW", "WITH",
]

# Multi-word keywords counted as one token, longest first.
MULTIWORD = [
    "LEFT OUTER JOIN", "RIGHT OUTER JOIN", "FULL OUTER JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN",
    "GROUP BY", "ORDER BY", "PARTITION BY", "CLUSTER BY", "DISTRIBUTE BY", "SORT BY", "UNION ALL",
    "INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN", "CROSS JOIN", "NATURAL JOIN",
]

LEXICON = KEYWORDS + MULTIWORD

# Literals, quoted names, line and block comments.
# No group is repeated in them: Java would recurse for each repetition.
_ESCAPED_RE = r"\\[\s\S]"
_TEXT_RE = r"'[^']*'" + '|"[^"]*"' + r"|--[^\n]*|/\*[\s\S]*?\*/"
LITERALS_RE = _TEXT_RE + "|`[^`]*`"
# Separator characters: ASCII non-word characters (';' is handled by the
# statement cut) and the Unicode blanks.  Mapped one-to-one by translate.
SEPARATORS = ("".join(chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) in "_;"))
              + "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b"
              + "\u2028\u2029\u3000\ufeff")
LITERAL_OPENERS = ("'", '"', "`", "--", "/*")
SEP1 = "\u0001"           # token separator (never in the output text)
SEP = SEP1 + SEP1         # a run becomes two: a fused phrase consumes one, its neighbour keeps one


def without_escapes(sql: Column) -> Column:
    """Drop backslash escapes, which only literals have, so that a quote ends its literal."""
    return F.when(sql.contains("\\"), F.regexp_replace(sql, _ESCAPED_RE, "")).otherwise(sql)


# What can open or close a text, and everything between.
_LEXEMES_RE = r"""/\*|\*/|--|\n|['"`]|[^'"`/*\n-]+|[\s\S]"""


def nests_comments(sql: Column) -> Column:
    return F.length(sql) - F.length(F.replace(sql, F.lit("/*"), F.lit(""))) >= 4


def strip_nested(sql: Column, keep_names: bool = False) -> Column:
    """Literals and comments out of texts whose block comments may nest, as Spark's
    do: one pass over all openers and closers with the depth of comments and the open
    quote (``-`` for a line comment); a text that is never closed goes to its end."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        depth, quote, out = s["depth"], s["quote"], s["out"]
        to = lambda d, q, o: F.struct(d.alias("depth"), q.alias("quote"), o.alias("out"))
        no, plain = F.lit(0), F.lit("")
        said = F.concat(out, t)
        name = F.when(F.lit(keep_names) & (quote == "`"), said).otherwise(out)
        return (F.when((depth > 0) & (t == "/*"), to(depth + 1, quote, out))
                .when((depth > 0) & (t == "*/"), to(depth - 1, quote, F.when(depth == 1, F.concat(out, F.lit(" "))).otherwise(out)))
                .when(depth > 0, s)
                .when((quote == "-") & (t == "\n"), to(no, plain, said))
                .when(quote == "-", s)
                .when((quote != "") & (t == quote), to(no, plain, F.concat(name, F.lit(" "))))
                .when(quote != "", to(no, quote, name))
                .when(t == "/*", to(no + 1, plain, out))
                .when(t == "--", to(no, F.lit("-"), out))
                .when(t.isin("'", '"', "`"), to(no, t, F.when(F.lit(keep_names) & (t == "`"), said).otherwise(F.concat(out, F.lit(" ")))))
                .otherwise(to(no, plain, said)))

    return F.aggregate(F.regexp_extract_all(sql, F.lit(_LEXEMES_RE), F.lit(0)), state, step, lambda s: s["out"])


def strip_literals(sql: Column) -> Column:
    """Blank literals and comments; the regex runs only on texts that contain
    a possible opener (cheap literal checks first)."""
    sql = without_escapes(sql)
    return (F.when(nests_comments(sql), strip_nested(sql)).when(has_opener(sql), F.regexp_replace(sql, LITERALS_RE, " "))
            .otherwise(sql))


def has_opener(sql: Column) -> Column:
    """Whether a literal, quoted name or comment may begin in a text."""
    has = sql.contains(LITERAL_OPENERS[0])
    for o in LITERAL_OPENERS[1:]:
        has = has | sql.contains(o)
    return has


def strip_to_names(sql: Column) -> Column:
    """Blank literals and comments but keep quoted names with their back-quotes."""
    sql = without_escapes(sql)
    return (F.when(nests_comments(sql), strip_nested(sql, keep_names=True))
            .when(has_opener(sql), F.regexp_replace(sql, f"{_TEXT_RE}|(`[^`]*`)", "$1 ")).otherwise(sql))


def first_statement(sql: Column) -> Column:
    return F.substring_index(sql, ";", 1)


def fused(phrase: str) -> tuple[str, str]:
    """(search, replacement) literals that fuse one multi-word keyword."""
    words = phrase.split(" ")
    return SEP1 + SEP.join(words) + SEP1, SEP1 + " ".join(words) + SEP1


def normalised(sql: Column, only_first_statement: bool = True) -> Column:
    """Upper-case word stream, words separated by SEP, phrases fused with blanks.

    Separator characters are mapped by ``translate`` (a per-character table
    lookup); only runs of two or more separators need the regex, which
    therefore matches rarely; a literal replace then doubles every separator
    so that adjacent fused phrases each find their own."""
    x = strip_literals(sql)
    seps = SEPARATORS
    if only_first_statement:
        x = first_statement(x)
    else:
        seps = seps + ";"
    x = F.translate(x, seps, SEP1 * len(seps))
    x = F.regexp_replace(x, SEP1 + SEP1 + "+", SEP1)
    x = F.concat(F.lit(SEP), F.upper(F.replace(x, F.lit(SEP1), F.lit(SEP))), F.lit(SEP))
    for phrase in MULTIWORD:
        search, repl = fused(phrase)
        x = F.replace(x, F.lit(search), F.lit(repl))
    return x


def sql_tokens(sql: Column, only_first_statement: bool = True) -> Column:
    """array<string> of upper-case tokens; fused phrases contain blanks.  Empty
    strings between separators are kept (they never match a keyword)."""
    return F.split(normalised(sql, only_first_statement), SEP1)


def sql_keywords(sql: Column, only_first_statement: bool = True) -> Column:
    """Only the lexicon tokens, in text order (row form; uses a lambda)."""
    return F.filter(sql_tokens(sql, only_first_statement), lambda t: t.isin(LEXICON))


def keyword_count_map(sql: Column) -> Column:
    """Row form of the histogram: map<keyword, count> (for per-row scorers)."""
    return count_map(sql_tokens(sql))


def count_map(tokens: Column) -> Column:
    """map<keyword, count> of a token array; null tokens have an empty map."""
    kws = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isin(LEXICON))
    distinct = F.array_sort(F.array_distinct(kws))
    return F.map_from_arrays(
        distinct, F.transform(distinct, lambda k: F.size(F.filter(kws, lambda t: t == k)).cast("int")))


def map_difference(gold: Column, cand: Column) -> Column:
    """gold - cand over the union of keys, missing counts as 0."""
    return F.map_zip_with(gold, cand, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def all_zero(m: Column) -> Column:
    return F.forall(F.map_values(m), lambda v: v == 0)


# ------------------------------------------------------------ small helpers

def metric_rename(metric: Column) -> Column:
    """'a/b/mean' -> 'avg_a_b' (drops the last path part)."""
    parts = F.split(metric, "/")
    return F.concat(F.lit("avg_"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_"))


def interleave(a: Column, b: Column) -> Column:
    """[a0, b0, a1, b1, ...] truncated to the shorter list (as zip does)."""
    n = F.least(F.size(a), F.size(b))
    return F.flatten(F.transform(F.slice(F.arrays_zip(a, b), 1, n), lambda x: F.array(x.getField("0"), x.getField("1"))))


def message_id(url: Column) -> Column:
    """Text after the last 'm='; the whole string when absent."""
    return F.substring_index(url, "m=", -1)


def is_three_part_name(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: F.trim(p) != "")


def strip_heading(h: Column) -> Column:
    """Trim blanks, then ':' from both ends."""
    return F.regexp_replace(F.trim(h), r"^:+|:+$", "")


def escape_replacement(s: str) -> str:
    """Literal replacement text for regexp_replace ($ and \\ are special)."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def render(template: str, bindings: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders from columns; unbound names are an error."""
    import re
    names = set(re.findall(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template))
    missing = names - set(bindings)
    if missing:
        raise KeyError(f"unbound template variables: {sorted(missing)}")
    # the template is cut once, so braces inside a value stay as they are
    pieces = re.split(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template)
    return F.concat(*(F.coalesce(bindings[x].cast("string"), F.lit("")) if i % 2 else F.lit(x)
                      for i, x in enumerate(pieces)))
