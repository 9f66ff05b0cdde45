"""SQL templates shared by both engines: named relations over base tables, with a few macros where dialects differ.

A template names other relations and base tables in braces. ``render`` collects what a relation needs as common table expressions;
base tables stay placeholders, to which ``spark.sql`` binds data frames and the SQL text binds table names. Spark writes such
expressions out wherever they are named, so ``run`` keeps those that are named more than once as tables in the shared folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pairlens.sources.cache import load_or_build

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_NAME = re.compile(r"\{(\w+)\}")
#: Numbers with a point are doubles, not decimals.
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")
#: macro -> (Spark, SQL of the tests); $1, $2 are its arguments
MACROS = {
    "PCT": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "HAS": ("rlike($1, $2)", "regexp_matches($1, $2)"),
    "SWAP": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "JOINED": ("array_join(array_sort(collect_list($1)), ';')", "array_to_string(list_sort(list($1)), ';')"),
    "DISTINCT_JOINED": ("array_join(array_sort(collect_set($1)), ';')", "array_to_string(list_sort(list(distinct $1)), ';')"),
    "DRAW": ("cast(conv(substr(md5(concat_ws('|', $1, $2)), 1, 8), 16, 10) as bigint)", "cast('0x' || substr(md5(concat_ws('|', $1, $2)), 1, 8) as bigint)"),
    "NUMBERS": ("(select cast(id as int) as i from range($1))", "(select cast(range as int) as i from range($1))"),
    "OVERLAP": ("size(array_intersect($1, $2))", "len(list_intersect($1, $2))"),
    "EITHER": ("size(array_union($1, $2))", "len(list_distinct(list_concat($1, $2)))"),
    "NAMES": ("collect_set($1)", "list(distinct $1)"),
    "DIGITS": ("array_sort(array_distinct(regexp_extract_all($1, '([0-9])', 1)))", "list_sort(list_distinct(regexp_extract_all($1, '([0-9])', 1)))"),
    "COUNT_OF": ("size($1)", "len($1)"),
    "TEXT": ("array_join($1, '-')", "array_to_string($1, '-')"),
    "FIRST_OF": ("element_at($1, 1)", "$1[1]"),
    "LAST_OF": ("element_at($1, -1)", "$1[-1]"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at ``at``, and the place after its end."""
    out, depth, start, quoted = [], 0, at + 1, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1 and not quoted:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"no end of call in {text[at:]}")


def expand(text: str, spark: bool) -> str:
    """``text`` with its macros in the dialect asked for; they may stand within each other."""
    pattern = re.compile(r"\b(" + "|".join(MACROS) + r")\(")
    while m := pattern.search(text):
        args, end = _arguments(text, m.end() - 1)
        body = MACROS[m[1]][0 if spark else 1]
        text = text[: m.start()] + re.sub(r"\$(\d)", lambda x: args[int(x[1]) - 1], body) + text[end:]
    return text


def render(name: str, book: dict[str, str], spark: bool, kept: frozenset[str] = frozenset()) -> str:
    """The relation as one statement; base tables and the relations in ``kept`` stand as placeholders (Spark) or names."""
    done: dict[str, str] = {}

    def need(x: str) -> None:
        if x in TABLES or x in done or (x in kept and x != name):
            return
        for y in _NAME.findall(book[x]):
            need(y)
        done[x] = book[x]

    need(name)
    final = done.pop(name)
    parts = ", ".join(f"{k} as ({v})" for k, v in done.items())
    text = (f"with {parts} " if parts else "") + final
    text = expand(_NAME.sub(lambda m: m[0] if spark and (m[1] in TABLES or m[1] in kept) else m[1], text), spark)
    return _DECIMAL.sub(r"\1e0", text)


def uses(name: str, book: dict[str, str]) -> dict[str, int]:
    """How often each relation is named in what ``name`` needs, if those named more than once are kept; what comes first stands first."""
    order: list[str] = []

    def visit(x: str) -> None:
        if x not in TABLES and x not in order:
            for y in _NAME.findall(book[x]):
                visit(y)
            order.append(x)

    visit(name)
    count = dict.fromkeys(order, 0)
    count[name] = 1
    for x in reversed(order):
        for y in _NAME.findall(book[x]):
            if y not in TABLES:
                count[y] += min(1, count[x])
    return count


def run(spark: SparkSession, sf_dir: str, name: str, book: dict[str, str]) -> DataFrame:
    """The relation over the tables of ``sf_dir``. What it would compute several times is computed once and kept in the shared folder."""
    tables = lambda text: {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_NAME.findall(text)) if t in TABLES}
    several = [x for x, n in uses(name, book).items() if n > 1 and x != name]
    kept: dict[str, DataFrame] = {}
    for x in several:
        whole = render(x, book, True)
        inputs = [f"{sf_dir}/{t}.parquet" for t in set(_NAME.findall(whole))]
        text = render(x, book, True, frozenset(kept))
        needed = {k: kept[k] for k in set(_NAME.findall(text)) if k in kept}
        kept[x] = load_or_build(spark, x, inputs, whole, lambda text=text, needed=needed: spark.sql(text, **tables(text), **needed))
    text = render(name, book, True, frozenset(kept))
    return spark.sql(text, **tables(text), **{k: kept[k] for k in set(_NAME.findall(text)) if k in kept})
