"""Mixing sources to target weights by temperature, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import cut, table

SEED = 17
#: Sources up to here are broadcast (a row of about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_key() -> Column:
    """A source's name with a mark before it, so that a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def weights(totals: DataFrame, entropy: float, repeats: float, budget: int | None, rounds: int = 60) -> DataFrame:
    """``totals`` (``key``, ``tokens``, ``docs``) with ``alpha``, ``weight``, ``target``.

    Shares to the power alpha are normalised to weights. alpha is bisected in [0, 1], first for the largest value whose weights have
    at least ``entropy`` times the entropy of equal weights, then for the least value at which no source is asked for more than
    ``repeats`` times its tokens; the larger of both counts (a power of 1 if the budget allows none). Sources without tokens get no
    weight. ``budget``: tokens in all, by default as many as there are. One row holds the list of the sources' shares meanwhile.
    """
    sized = totals.where("tokens > 0")
    one = sized.agg(F.collect_list(F.col("tokens").cast("double")).alias("t"), F.sum("tokens").cast("double").alias("all"))
    one = one.withColumn("budget", F.lit(float(budget)) if budget is not None else F.col("all"))
    one = one.withColumn("p", F.expr("transform(array_sort(t), x -> x / all)"))
    power = "aggregate(p, 0D, (s, x) -> s + exp(({a}) * ln(x)))"
    entropy_at = "(ln({z}) - ({a}) * aggregate(p, 0D, (s, x) -> s + exp(({a}) * ln(x)) * ln(x)) / {z})".replace("{z}", power)
    most_at = "(budget / all * aggregate(p, 0D, (s, x) -> greatest(s, exp((({a}) - 1D) * ln(x)))) / {z})".replace("{z}", power)

    def bisect(holds_low: str, low: bool) -> str:
        """holds_low: true while alpha may rise. low: which end counts."""
        half = "(e.lo + e.hi) / 2D"
        test = holds_low.replace("{a}", half)
        step = f"if({test}, named_struct('lo', {half}, 'hi', e.hi), named_struct('lo', e.lo, 'hi', {half}))"
        return f"aggregate(sequence(1, {rounds}), named_struct('lo', 0D, 'hi', 1D), (e, i) -> {step}, e -> e.{'lo' if low else 'hi'})"

    want = f"{entropy_at} >= {entropy}D * ln(size(p))"
    over = f"{most_at} > {float(repeats)}D"
    one = one.withColumn("a_entropy", F.expr(f"if({want.replace('{a}', '1D')}, 1D, {bisect(want, True)})"))
    one = one.withColumn("a_repeats", F.expr(f"if(not ({over.replace('{a}', '0D')}), 0D, if({over.replace('{a}', '1D')}, 1D, {bisect(over, False)}))"))
    one = one.withColumn("alpha", F.greatest("a_entropy", "a_repeats")).withColumn("z", F.expr(power.replace("{a}", "alpha")))
    one = cut(one.select("all", "budget", "alpha", "z"))
    weight = F.expr("if(tokens > 0, exp(alpha * ln(tokens / all)) / z, 0D)")
    return totals.crossJoin(F.broadcast(one)).withColumn("weight", weight).select(*totals.columns, "alpha", "weight", F.floor(F.col("weight") * F.col("budget") + F.lit(1e-3)).alias("target"))


def _block(most: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), most).cast("int")


def plan(meta: DataFrame, entropy: float, repeats: float, budget: int | None, block_docs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What each source gives, and the documents of the blocks where a source's budget ends.

    ``meta``: ``doc_id``, ``key``, ``n_tokens``. A source's documents are dealt by a hash of doc_id into blocks of about
    ``block_docs`` (65,536 blocks at most); a block's number is its place in the source's order. Whole rounds of a source come
    first, then its blocks in order until the rest of its target is used; in the last block documents are taken in order of a
    second hash while they fit. Only that block is sorted by document.
    """
    totals = cut(meta.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    given = weights(totals, entropy, repeats, budget)
    given = given.withColumn("blocks", F.least(F.lit(65_536), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs))).cast("long"))
    given = given.withColumn("rounds", F.expr("if(tokens > 0, target div tokens, 0)").cast("int"))
    given = cut(given.withColumn("rest", F.expr("if(tokens > 0, target - rounds * tokens, 0)")))
    dealt = join_sources(meta, given.select("key", "blocks")).withColumn("block", _block(F.col("blocks"), seed))
    sums = dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("sum"))
    upto = sums.select("key", "block", "sum", F.sum("sum").over(Window.partitionBy("key").orderBy("block")).alias("upto"))
    ends = upto.join(given.select("key", "rest"), "key").where("upto > rest").groupBy("key").agg(F.min("block").alias("last"), F.min_by(F.col("upto") - F.col("sum"), "block").alias("used"))
    sources = cut(given.join(ends, "key", "left").withColumn("last", F.coalesce("last", F.col("blocks").cast("int"))))
    edge = join_sources(meta, sources.select("key", "blocks", "last", "used", "rest")).where((_block(F.col("blocks"), seed) == F.col("last")) & F.col("doc_id").isNotNull())
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("here", F.sum("n_tokens").over(order) + F.col("used"))
    taken = cut(edge.groupBy("key", "doc_id").agg(F.max("here").alias("here"), F.first("rest").alias("rest")).where("here <= rest").select(F.col("key").alias("edge_key"), F.col("doc_id").alias("edge_id")))
    return sources, taken


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources, "key")


def copies_of(rows: DataFrame, sources: DataFrame, taken: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with ``key``, ``doc_id``) and ``alpha``, ``weight``, ``block``, ``copies``."""
    out = join_sources(rows, sources.select("key", "alpha", "weight", "blocks", "rounds", "last")).withColumn("block", _block(F.col("blocks"), seed))
    # taken: a block's documents for each source, checked like the sources
    small = F.broadcast(taken) if taken.count() <= BROADCAST_SOURCES else taken
    out = out.join(small, (F.col("doc_id") == F.col("edge_id")) & (F.col("key") == F.col("edge_key")), "left")
    more = (F.col("block") < F.col("last")) | F.col("edge_id").isNotNull()
    return out.withColumn("copies", F.col("rounds") + more.cast("int")).drop("edge_key", "edge_id", "blocks", "rounds", "last")


def mix(docs: DataFrame, entropy: float = 0.95, repeats: float = 4.0, budget: int | None = None, block_docs: int = 256, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``alpha``, ``weight``, ``block``, ``copies`` of every row.

    A null source is a source of its own. Null and empty texts have no tokens and follow their block. Rows that share a doc_id
    within a source are taken together; rows with a null doc_id are taken in whole rounds and whole blocks only. An empty table
    gives no rows. Other columns are ignored.
    """
    meta = cut(docs.select(F.col("doc_id").cast("long"), source_key().alias("key"), n_tokens().alias("n_tokens")))
    sources, taken = plan(meta, entropy, repeats, budget, block_docs, seed)
    out = copies_of(meta, sources, taken, seed)
    return out.select("doc_id", F.expr("if(key = '', null, substr(key, 2))").alias("source"), "n_tokens", "alpha", "weight", "block", "copies")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, entropy: float = 0.95, repeats: float = 4.0) -> DataFrame:
    """Pipeline stage: every document as often as the mixture asks for it (not at all, once, or in several rounds)."""
    meta = cut(docs.select(F.col("doc_id").cast("long"), source_key().alias("key"), n_tokens().alias("n_tokens")))
    sources, taken = plan(meta, entropy, repeats, None, 256, SEED)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"))
    out = copies_of(rows, sources, taken, SEED).where("copies > 0")
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
