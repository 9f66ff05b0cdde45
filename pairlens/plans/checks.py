"""Queries of geometry permutations, rerankers with quality gates and reliability of targets, with SQL by another route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.operators import geometry_null as G
from pairlens.operators import pools as P
from pairlens.operators import quality_rerank as Q
from pairlens.operators import retrieval as R
from pairlens.operators import sensitivity as V
from pairlens.operators import targets as T
from pairlens.sources.cache import checkpointed

ROUNDS = 5000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs(R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier")))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def traits(spark: SparkSession, d: str) -> DataFrame:
    """Of every nation's lines by line status: the commonest part type (ties: the first by name), mean part size / 6 and its deviation / 6."""
    lines = _table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_linestatus").alias("task"))
    made = lines.join(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("subject")), "l_suppkey")
    typed = made.join(_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.col("p_size").cast("long").alias("size")), "l_partkey")
    kinds = typed.groupBy("subject", "task", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"))
    whole = kinds.groupBy("subject", "task").agg(F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type"))).alias("source"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))))
    return whole.select(F.concat_ws("|", "subject", "task").alias("id"), "task", "source", F.round(F.col("s") / F.col("n") / 6, 6).alias("center"), F.round(spread / 6, 6).alias("span"))


def _fractions(spark: SparkSession, d: str) -> DataFrame:
    """Places of all candidates of each pair, as shares of the list."""
    rows = P.pool_scores(_pairs(spark, d), ("all",))
    share = F.when(F.col("n_candidates") > 1, (F.col("rank") - 1) / (F.col("n_candidates") - 1)).otherwise(F.lit(1.0))
    query, candidate = F.concat_ws("|", "q_subject", "q_task"), F.concat_ws("|", "c_subject", "c_task")
    return rows.select(query.alias("query"), candidate.alias("candidate"), (query == candidate).alias("is_true"), share.alias("rank_fraction"))


def _geometry(spark: SparkSession, d: str, strata: list[str]) -> DataFrame:
    return _rounded(G.null_by_metric(G.geometry_permutations(_fractions(spark, d), traits(spark, d), ROUNDS, strata)))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose off state has a number of lines that 5 divides are of low quality, else those that 3 divides are to be used with caution."""
    vectors = R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier"))
    n = F.col("n_rows")
    flags = vectors.where("state = 'A'").select("subject", "task", F.when(n % 5 == 0, "low_quality").when(n % 3 == 0, "caution").otherwise("good").alias("quality"))
    pairs = R.pairs(vectors)
    return Q.reranked(Q.terms(P.pool_scores(pairs), P.pool_scores(P.reverse_pairs(pairs), ("all",)), flags))


#: Measures of lines and what brings their hundredths to one size; tax stands for edges, the part type ECONOMY for sensitive nodes.
MEASURES = {"quantity": ("l_quantity", 1000), "price": ("l_extendedprice", 1000000), "discount": ("l_discount", 5), "tax": ("l_tax", 5)}
NODES = ("ECONOMY",)


def target_states(spark: SparkSession, d: str) -> DataFrame:
    """Mean measures by part type (features) of every nation's customers, order priority (task) and return flag A (off) or R (on).

    ``quality`` is that of the nation's task, by its number of off lines.
    """
    lines = _table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").join(_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "l_orderkey")
    lines = lines.join(_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("subject")), "c_custkey").join(_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("type")), "l_partkey")
    tasks = F.create_map(*(F.lit(x) for pair in (("1", "HoldL"), ("2", "HoldR"), ("3", "MoveL"), ("4", "MoveR")) for x in pair))
    task = F.coalesce(tasks[F.left("o_orderpriority", F.lit(1))], F.lit("Rest")).alias("task")
    medication = F.when(F.col("l_returnflag") == "A", "off").otherwise("on").alias("medication")
    means = lines.groupBy("subject", task, medication, "type").agg(F.count(F.lit(1)).alias("n"), *((F.sum(F.round(F.col(c) * 100).cast("long")) / (F.count(F.lit(1)) * size)).alias(m) for m, (c, size) in MEASURES.items()))
    n = F.sum(F.when(F.col("medication") == "off", F.col("n")).otherwise(0)).over(Window.partitionBy("subject", "task"))
    quality = F.when(n % 5 == 0, "low_quality").when(n % 3 == 0, "caution").otherwise("good").alias("quality")
    long = F.explode(F.array(*(F.struct(F.concat("type", F.lit(f"_{m}")).alias("feature"), F.col(m).alias("value")) for m in MEASURES))).alias("e")
    return means.select("subject", "task", "medication", quality, "type", long).select("subject", "task", "medication", "quality", "e.feature", "e.value")


def _descriptors(states: DataFrame) -> DataFrame:
    kind = F.when(F.col("feature").endswith("_tax"), T.EDGE).otherwise("node_band_modulation")
    return states.select("feature").distinct().select("feature", F.upper(F.substring_index("feature", "_", 1)).alias("node"), kind.alias("target_type"))


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """States and the rankings of their contexts."""
    states = checkpointed(target_states(spark, d))
    return states, T.rank_targets(states, _descriptors(states), NODES)


def _left_out(spark: SparkSession, d: str) -> DataFrame:
    states = checkpointed(target_states(spark, d))
    return T.rank_without_subjects(states, _descriptors(states), NODES)


def _reliabilities(spark: SparkSession, d: str, **only: str) -> tuple[DataFrame, DataFrame]:
    states, ranks = _targets(spark, d)
    ranks = checkpointed(ranks)
    people = states.select("subject").distinct().count()
    base = T.reliability(ranks, people, known=_descriptors(states))
    return base, T.sideaware_reliability(ranks, base, _descriptors(states), **only)


def _subsets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pairs, and their subsets: all, without each subject, without each task, of each task only."""
    pairs = checkpointed(_pairs(spark, d))
    members = V.whole(pairs).unionByName(V.left_out(pairs, "subject", "without_subject")).unionByName(V.left_out(pairs, "task", "without_task")).unionByName(V.kept_only(pairs, "task", "only_task"))
    return pairs, members


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "geometry_traits": traits,
        "geometry_permutation_null": lambda s, d: _geometry(s, d, []),
        "geometry_permutation_null_in_tasks": lambda s, d: _geometry(s, d, ["task"]),
        "quality_rerank": lambda s, d: _reranked(s, d).select(*Q.LIST, *P.CANDIDATE, "applied", "new_score", "new_rank"),
        "quality_rerank_components": lambda s, d: _rounded(Q.components(_reranked(s, d)), 10),
        "quality_rerank_first_places": lambda s, d: _rounded(Q.first_places(_reranked(s, d))),
        "refitted_scores": lambda s, d: P.gated(V.refitted_scores(*_subsets(s, d))).select(*P.QUERY, *P.CANDIDATE, "score", "second", "rank", "new_rank"),
        "refit_sensitivity": lambda s, d: _rounded(V.sensitivity(*_subsets(s, d))),
        "target_states": target_states,
        "target_ranks": lambda s, d: _rounded(_targets(s, d)[1], 10),
        "targets_without_subjects": lambda s, d: _rounded(_left_out(s, d).withColumn("removed_subject", F.coalesce(F.col("removed_subject").cast("string"), F.lit("nobody"))), 10),
        "target_left_out_stability": lambda s, d: _rounded(T.left_out_stability(_left_out(s, d))),
        "target_reliability": lambda s, d: _rounded(_reliabilities(s, d)[0]),
        "target_reliability_sideaware": lambda s, d: _rounded(_reliabilities(s, d)[1]),
        "target_reliability_weights": lambda s, d: _rounded(T.reliability_weights(*_reliabilities(s, d))),
    }


_TRAITS = """tl as (select s_nationkey || '|' || l_linestatus as id, l_linestatus as task, p_type, p_size from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey),
    tm as (select id, p_type as source, row_number() over (partition by id order by count(*) desc, p_type) as i from tl group by id, p_type),
    tr as materialized (select tl.id, task, source, round(avg(p_size) / 6, 6) as center, round(stddev_samp(p_size) / 6, 6) as span from tl join tm on tm.id = tl.id and i = 1 group by all)"""


def _dealt(base: str, strata: str) -> str:
    """Every round scored and ranked in full, list by list."""
    far = lambda c, whole: f"case when q.{c} is null or c.{c} is null then 0.5 else least(abs(q.{c} - c.{c}) / {whole}, 1) end"
    return f"""with {base}, {_TRAITS}, fr as materialized (select q_subject || '|' || q_task as query, c_subject || '|' || c_task as candidate, case when n_candidates > 1 then (rank - 1) / (n_candidates - 1) else 1 end as fraction from f where condition = 'all'),
        a as (select r.round, tr.*, row_number() over (partition by r.round{strata} order by id) as i, row_number() over (partition by r.round{strata} order by case when r.round > 0 then cast('0x' || substr(md5(r.round || '|' || id), 1, 8) as bigint) end, id) as j
            from tr, range({ROUNDS + 1}) r(round) where id in (select query from fr)),
        g as materialized (select x.round, x.id, y.source, y.center, y.span from a x join a y on x.round = y.round and x.i = y.j{" and x.task = y.task" if strata else ""}),
        soft as (select q.round, query, candidate, fraction, round(fraction + 0.5 * (q.source <> c.source)::int + 0.25 * ({far("center", 8)} + 0.5 * {far("span", 4)}), 9) as score from g q join fr on fr.query = q.id join tr c on c.id = candidate),
        rk as (select round, query, candidate, row_number() over (partition by round, query order by score, fraction, candidate) as place, count(*) over (partition by round, query) as n from soft),
        m as (select round, unnest([{{'metric': 'top1', 'value': avg((place = 1)::int)}}, {{'metric': 'mrr', 'value': avg(1 / place)}}, {{'metric': 'percentile', 'value': avg(1 - (place - 1) / greatest(1, n - 1))}}], recursive := true) from rk where query = candidate group by round)
        select n.metric, count(*) as n_rounds, round(o.value, 6) as observed, round(avg(n.value), 6) as null_mean, round(stddev_samp(n.value), 6) as null_sd, round((1 + count(*) filter (n.value >= o.value - 1e-12)) / (1 + count(*)), 6) as p_value
        from m n join m o on o.metric = n.metric and o.round = 0 where n.round > 0 group by n.metric, o.value"""


def _gates(base: str) -> str:
    """The variants one by one, from the ranked candidates of both directions."""
    z = lambda c: f"(({c}) - avg({c}) over w) / case when stddev_pop({c}) over w >= 1e-8 then stddev_pop({c}) over w else 1 end"
    quality = "+ 2 * (fq <> fc)::int"
    near = "- (front and behind)::int - overlap"
    confounds = "+ 2 * (q_task <> c_task)::int + 2 * (q_subject = c_subject and q_task <> c_task)::int"
    sums = {
        "neighbours": (near, "true"), "neighbours_quality": (f"{near} {quality}", "true"), "neighbours_quality_confounds": (f"{near} {quality} {confounds}", "n_candidates >= 20"),
        "quality_confounds": (f"{quality} {confounds}", "n_candidates >= 20"), "quality_confounds_blind": (f"{quality} + 2 * (q_task <> c_task)::int + 2 * (q_subject = c_subject)::int", "n_candidates >= 20"),
    }
    each = " union all ".join(f"select '{n}' as variant, {when} as applied, round(case when {when} then sum_z {terms} else score end, 6) as new_score, * from tm" for n, (terms, when) in sums.items())
    return f"""with {base}, fl as (select subject, task, case when n_rows % 5 = 0 then 'low_quality' when n_rows % 3 = 0 then 'caution' else 'good' end as flag from v where state = 'A'),
        near as materialized (select condition, q_subject as s, q_task as t, c_subject || '|' || c_task as name from f where rank <= 5), far as materialized (select c_subject as s, c_task as t, q_subject || '|' || q_task as name from f where condition = 'all' and back_rank <= 5),
        common as (select condition, near.s as q_subject, near.t as q_task, far.s as c_subject, far.t as c_task, count(*) as shared from near join far using (name) group by all),
        nn as (select condition, s as q_subject, t as q_task, count(*) as k from near group by all), nf as (select s as c_subject, t as c_task, count(*) as k from far group by all),
        tm as materialized (select f.*, b.back_rank as reverse_rank, f.rank <= 5 as front, b.back_rank <= 5 as behind, round(coalesce(shared, 0) / (nn.k + nf.k - coalesce(shared, 0)), 6) as overlap, q.flag as fq, c.flag as fc, {z("f.score")} + {z("f.back")} as sum_z
            from f join f b on b.condition = 'all' and b.q_subject = f.q_subject and b.q_task = f.q_task and b.c_subject = f.c_subject and b.c_task = f.c_task left join common m on m.condition = f.condition and m.q_subject = f.q_subject and m.q_task = f.q_task and m.c_subject = f.c_subject and m.c_task = f.c_task
            join nn on nn.condition = f.condition and nn.q_subject = f.q_subject and nn.q_task = f.q_task join nf on nf.c_subject = f.c_subject and nf.c_task = f.c_task
            join fl q on q.subject = f.q_subject and q.task = f.q_task join fl c on c.subject = f.c_subject and c.task = f.c_task window w as (partition by f.condition, f.q_subject, f.q_task)),
        ev as (select *, cast(row_number() over (partition by variant, condition, q_subject, q_task order by new_score, rank) as int) as new_rank from ({each}))"""


def _places(source: str, by: str) -> str:
    """Relations ``rp``: every context of ``source`` (``by``, off, feature, value) ranked from its own rows."""
    return f"""mo as (select {by}, feature, avg(value) filter (off) as cur, avg(value) filter (not off) as tgt, avg(value) as mid, stddev_samp(value) filter (not off) as d_on, stddev_samp(value) as d_all, count(*) filter (off) as n_off, count(*) filter (not off) as n_on from {source} group by {by}, feature),
        mf as (select *, max(n_off) over c as any_off, max(n_on) over c as any_on from mo window c as (partition by {by})),
        mg as (select {by}, feature, case when any_off > 0 then cur else mid end as cur, case when any_on > 0 then tgt else mid end as tgt, greatest(coalesce(case when any_on > 1 then d_on else d_all end, 0), 0.1) as d from mf),
        mh as (select *, 0.6 * (tgt - cur) as effect, case when feature like 'economy%' then 0.6 else 0.25 end + case when ends_with(feature, '_tax') then 0.1 else 0 end as risk from mg where cur is not null and tgt is not null),
        mp as (select *, sqrt(avg(pow((tgt - cur) / d, 2)) over c) as before, sqrt((sum(pow((tgt - cur) / d, 2)) over c - pow((tgt - cur) / d, 2) + pow((tgt - cur - effect) / d, 2)) / count(*) over c) as post from mh window c as (partition by {by})),
        mq as (select *, 0.05 + 0.05 * abs(effect) + 0.1 * risk as uncertainty, 1 / (1 + abs(effect)) as stability_estimate, round(before - post, 9) as gain from mp),
        mr as (select *, round(post + 0.15 * effect * effect + 0.25 * risk + 0.1 * case when ends_with(feature, '_tax') then 0.45 else 0.25 end - 0.2 * stability_estimate, 9) as objective from mq),
        rp as materialized (select {by}, feature, cast(row_number() over (partition by {by} order by objective, gain desc, feature) as int) as rank, objective, gain as expected_delta_deviation, effect as effect_size, uncertainty, stability_estimate from mr)"""


def _states() -> str:
    means = ", ".join(f"sum(cast(round({c} * 100) as bigint))::double / (count(*) * {size}) as {m}" for m, (c, size) in MEASURES.items())
    rows = " union all ".join(f"select subject, task, medication, quality, type || '_{m}' as feature, {m} as value from qs" for m in MEASURES)
    return f"""ln as (select c_nationkey as subject, case left(o_orderpriority, 1) when '1' then 'HoldL' when '2' then 'HoldR' when '3' then 'MoveL' when '4' then 'MoveR' else 'Rest' end as task, case l_returnflag when 'A' then 'off' else 'on' end as medication, lower(p_type) as type, lineitem.*
            from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey where l_returnflag in ('A', 'R')),
        ns as (select subject, task, count(*) filter (medication = 'off') as n from ln group by all),
        qs as (select ln.subject, ln.task, medication, case when n % 5 = 0 then 'low_quality' when n % 3 = 0 then 'caution' else 'good' end as quality, type, {means} from ln join ns on ns.subject = ln.subject and ns.task = ln.task group by all),
        ts as materialized ({rows})"""


def _in_contexts() -> str:
    """``cx``: the states of each context, one select a kind of context; then their rankings."""
    kinds = [("overall", "'all_recordings'", "true", "''", "''", "''", "''"), ("task", "task", "task in ('HoldL', 'MoveL')", "task", "''", "''", "''"), ("subject_task", "task || ':' || subject", "true", "task", "subject::varchar", "''", "''"),
             ("quality", "'exclude_low_quality'", "quality <> 'low_quality'", "''", "''", "''", "''"), ("quality", "'good_only'", "quality = 'good'", "''", "''", "''", "''"), ("sideaware", "task", "task <> 'Rest'", "left(task, 4)", "''", "right(task, 1)", "left(task, 4)"),
             ("sideaware", "'left_side'", "task in ('HoldL', 'MoveL')", "''", "''", "'L'", "''"), ("sideaware", "'right_side'", "task in ('HoldR', 'MoveR')", "''", "''", "'R'", "''"),
             ("sideaware", "'hold_family'", "task like 'Hold%'", "'Hold'", "''", "''", "'Hold'"), ("sideaware", "'move_family'", "task like 'Move%'", "'Move'", "''", "''", "'Move'")]
    rows = " union all ".join(f"select '{k}' as rank_source, '{k}:' || {n} as rank_context, {t} as task_context, {u} as subject_context, {s} as side_context, {f} as family_context, medication = 'off' as off, feature, value from ts where {w}" for k, n, w, t, u, s, f in kinds)
    return f"with {_states()}, cx as materialized ({rows}), {_places('cx', ', '.join(T.CONTEXT))}"


def _scored(name: str, sources: str, last: str) -> str:
    """``<name>``: every feature in every context of the sources, missing ones written out, and their statistics."""
    return f"""{name}_o as materialized (select * from rp where rank_source in {sources}), {name}_n as (select distinct feature from ts),
        {name}_c as (select distinct rank_source, rank_context from {name}_o), {name}_w as (select 1 + greatest((select max(rank) from {name}_o), (select count(*) from {name}_n)) as gone),
        {name}_a as (select c.rank_source, c.rank_context, n.feature, o.task_context, o.subject_context, o.side_context, o.family_context, coalesce(o.rank, gone) as rank, expected_delta_deviation, uncertainty, stability_estimate
            from {name}_c c cross join {name}_n n cross join {name}_w left join {name}_o o on o.rank_context = c.rank_context and o.feature = n.feature),
        {name}_s as (select feature, count(*) as n_contexts, avg((rank <= 5)::int) as top5_frequency, avg((rank <= 10)::int) as top10_frequency, avg(rank) as mean_rank, median(rank) as median_rank, stddev_pop(rank) as rank_sd,
            count(distinct subject_context) filter (rank <= 10 and rank_source = 'subject_task') as n_subjects, count(distinct task_context) filter (rank <= 10 and task_context in ('HoldL', 'MoveL')) as n_tasks,
            coalesce(bool_or(rank <= 10) filter (rank_context like 'quality:exclude%'), false) as survives, coalesce(bool_or(rank <= 10) filter (rank_context = 'quality:good_only'), false) as in_good, avg(expected_delta_deviation) as mean_expected_delta, avg(uncertainty) as mean_uncertainty,
            least(greatest(coalesce(avg(stability_estimate), 0.5), 0), 1) as stability, (coalesce(bool_or(rank <= 10) filter (side_context = 'L'), false)::int + coalesce(bool_or(rank <= 10) filter (side_context = 'R'), false)::int) / 2 as side_coverage,
            (coalesce(bool_or(rank <= 10) filter (family_context = 'Hold'), false)::int + coalesce(bool_or(rank <= 10) filter (family_context = 'Move'), false)::int) / 2 as family_coverage from {name}_a group by feature),
        {name} as materialized (select * exclude ({last}), least(greatest(1 - (mean_rank - 1) / greatest(1, (select greatest(max(rank), count(distinct feature)) from {name}_a) - 1), 0), 1) as rank_score,
            coalesce(case when max(mean_uncertainty) over () - min(mean_uncertainty) over () <= 1e-8 + 1e-5 * abs(min(mean_uncertainty) over ()) then 0.5 else 1 - (mean_uncertainty - min(mean_uncertainty) over ()) / (max(mean_uncertainty) over () - min(mean_uncertainty) over ()) end, 0.5) as uncertainty_score,
            (survives::int + in_good::int) / 2 as quality_survival from {name}_s)"""


_RELIABLE = f"""{{0}}, {_scored("ba", "('overall', 'task', 'subject_task', 'quality')", "side_coverage, family_coverage")},
    bs as materialized (select *, n_subjects / (select count(distinct subject) from ts) as subject_coverage, n_tasks / 2 as task_coverage from ba),
    rb as materialized (select *, 0.25 * top10_frequency + 0.15 * rank_score + 0.15 * subject_coverage + 0.1 * task_coverage + 0.15 * quality_survival + 0.1 * uncertainty_score + 0.1 * stability as reliability_score from bs),
    {_scored("si", "('sideaware', 'quality')", "n_subjects, n_tasks")},
    rs as materialized (select si.*, bs.n_subjects, bs.n_tasks, bs.subject_coverage, 0.2 * si.top10_frequency + 0.15 * si.rank_score + 0.1 * bs.subject_coverage + 0.1 * si.side_coverage + 0.1 * si.family_coverage + 0.15 * si.quality_survival + 0.1 * si.uncertainty_score
        + 0.1 * si.stability as sideaware_reliability_score from si join bs on bs.feature = si.feature)"""


_RANKED = ("objective", "expected_delta_deviation", "effect_size", "uncertainty", "stability_estimate")
_COUNTED = ("top5_frequency", "top10_frequency", "mean_rank", "median_rank", "rank_sd", "mean_expected_delta", "mean_uncertainty", "stability", "rank_score", "uncertainty_score", "quality_survival", "subject_coverage")


def _six(source: str, *names: str, digits: int = 6, more: str = "") -> str:
    return f"select * replace ({', '.join(f'round({n}, {digits}) as {n}' for n in names)}{more}) from {source}"


def _refits() -> str:
    """Relations after the pairs ``p``: every subset's scales from its own rows, its lists, and their order by both scores."""
    f = R.FEATURES
    off, on = ", ".join(f"x_{c} as f_{c}" for c in f), ", ".join(f"x_{c} + y_{c} as f_{c}" for c in f)
    scale = ", ".join(f"avg(f_{c}) as m_{c}, case when stddev_samp(f_{c}) >= 1e-8 then stddev_samp(f_{c}) else 1 end as d_{c}" for c in f)
    q, c = {x: f"(q.x_{x} - m_{x}) / d_{x}" for x in f}, {x: f"(c.x_{x} + c.y_{x} - m_{x}) / d_{x}" for x in f}
    cosine = " + ".join(f"coalesce(1 - list_cosine_similarity([{', '.join(q[x] for x in g)}], [{', '.join(c[x] for x in g)}]), 1)" for g in P.GROUPS)
    z = lambda x: f"((-{x}) - avg(-{x}) over w) / case when stddev_pop({x}) over w > 1e-9 then stddev_pop({x}) over w else 1 end"
    return f"""mb as materialized (select 'all' as condition, p.* from p union all select 'without_subject:' || s.subject, p.* from p join (select distinct subject from p) s on s.subject <> p.subject
            union all select 'without_task:' || s.task, p.* from p join (select distinct task from p) s on s.task <> p.task union all select 'only_task:' || task, p.* from p),
        sm as (select condition, subject, {off} from mb union all select condition, subject, {on} from mb),
        zz as materialized (select s.condition, s.subject, {scale} from (select distinct condition, subject from mb) s join sm on sm.condition = s.condition and sm.subject <> s.subject group by all having count(*) > 1),
        ll as materialized (select q.condition, q.subject as q_subject, q.task as q_task, c.subject as c_subject, c.task as c_task, round(({cosine}) / {len(P.GROUPS)}, 6) as score, round(abs({q["price"]} - {c["price"]}), 6) as second
            from mb q join zz on zz.condition = q.condition and zz.subject = q.subject join mb c on c.condition = q.condition and c.task = q.task),
        l1 as (select *, cast(row_number() over (partition by condition, q_subject, q_task order by score, c_subject) as int) as rank from ll),
        l2 as (select *, round(case when rank <= {P.TOP_K} then -({z("score")} + {P.SECOND_WEIGHT} * ({z("second")})) else 1000.0 + rank end, 6) as fused from l1 window w as (partition by condition, q_subject, q_task, rank <= {P.TOP_K})),
        l3 as materialized (select *, cast(row_number() over (partition by condition, q_subject, q_task order by fused, c_subject) as int) as new_rank from l2)"""


def oracle_sql(base: str, pairs: str) -> dict[str, str]:
    """``pairs``: a WITH clause's relations up to ``p``, the pairs; ``base``: a WITH clause's relations up to ``f``, the ranked candidates of each condition in both directions."""
    own, right = "q_subject = c_subject", "q_subject = c_subject and q_task = c_task"
    reliable = _RELIABLE.format(_in_contexts())
    out = f"with {_states()}, cx as materialized (select s.removed_subject, ts.medication = 'off' as off, feature, value from (select distinct subject as removed_subject from ts union all select null) s join ts on ts.subject is distinct from s.removed_subject), {_places('cx', 'removed_subject')}"
    share = lambda x, on: f"round(avg(({x})::int) filter ({on}), 6)"
    return {
        "geometry_traits": f"with {_TRAITS} select id, task, source, center, span from tr",
        "geometry_permutation_null": _dealt(base, ""),
        "geometry_permutation_null_in_tasks": _dealt(base, ", task"),
        "refitted_scores": f"with {pairs}, {_refits()} select condition, q_subject, q_task, c_subject, c_task, score, second, rank, new_rank from l3",
        "refit_sensitivity": f"""with {pairs}, {_refits()}, ra as (select condition, count(*) as n_queries, avg((rank = 1)::int) as base_top1, avg(1 / rank) as base_mrr, avg((new_rank = 1)::int) as gated_top1, avg(1 / new_rank) as gated_mrr from l3 where q_subject = c_subject group by condition),
            si as (select condition, count(*) as n_pairs, count(distinct subject) as n_subjects from mb group by condition), wh as (select gated_top1 as t, gated_mrr as r from ra where condition = 'all')
            select condition, n_pairs, n_subjects, n_queries, {", ".join(f"round({n}, 6) as {n}" for n in ("base_top1", "base_mrr", "gated_top1", "gated_mrr"))}, round(t - gated_top1, 6) as top1_drop, round(r - gated_mrr, 6) as mrr_drop, round(gated_top1 - base_top1, 6) as gain_top1,
            round(gated_mrr - base_mrr, 6) as gain_mrr, t - gated_top1 >= 0.25 - 1e-12 or r - gated_mrr >= 0.2 - 1e-12 or gated_top1 <= 0.5 as collapse from si left join ra using (condition), wh""",
        "target_states": f"with {_states()} select * from ts",
        "target_ranks": f"{_in_contexts()} {_six('rp', *_RANKED, digits=10)}",
        "targets_without_subjects": f"""{out} {_six("rp", *_RANKED, digits=10, more=", coalesce(removed_subject::varchar, 'nobody') as removed_subject")}""",
        "target_left_out_stability": f"""{out}, fu as (select feature, rank as first from rp where removed_subject is null) select removed_subject, max(feature) filter (rank = 1) as top1_feature, count(*) filter (rank <= 10 and first <= 10) as top10_overlap,
            round(count(*) filter (rank <= 10 and first <= 10) / 10, 6) as top10_overlap_fraction, max(rank) filter (first = 1) - 1 as full_top1_shift, coalesce(max(rank) filter (first = 1) <= 10, false) as full_top1_stays from rp left join fu using (feature) where removed_subject is not null group by removed_subject""",
        "target_reliability": f"{reliable} {_six('rb', *_COUNTED, 'task_coverage', 'reliability_score')}",
        "target_reliability_sideaware": f"{reliable} {_six('rs', *_COUNTED, 'side_coverage', 'family_coverage', 'sideaware_reliability_score')}",
        "target_reliability_weights": f"{reliable}, av as (select feature, avg(v) as v from (select feature, reliability_score as v from rb union all select feature, sideaware_reliability_score from rs) u group by feature) select feature, round(least(greatest(v / max(v) over (), 0.05), 1), 6) as weight from av",
        "quality_rerank": f"{_gates(base)} select variant, condition, q_subject, q_task, c_subject, c_task, applied, new_score, new_rank from ev",
        "quality_rerank_components": f"""{_gates(base)} select variant, condition, q_subject, q_task, max(n_candidates) as n_candidates, bool_or(applied) as applied, max(rank) filter ({right}) as forward_rank, max(reverse_rank) filter ({right}) as reverse_rank,
            max(new_rank) filter ({right}) as new_rank, bool_or(front and behind) filter ({right}) as true_mutual, max(overlap) filter ({right}) as true_overlap, bool_or(fq <> fc) filter ({right}) as true_other_quality, count(*) filter (front and behind) as n_mutual,
            round(avg(overlap), 10) as mean_overlap, count(*) filter (fq <> fc) as n_other_quality, count(*) filter (q_task <> c_task) as n_other_task, count(*) filter ({own} and q_task <> c_task) as n_same_subject_wrong from ev group by variant, condition, q_subject, q_task""",
        "quality_rerank_first_places": f"""{_gates(base)} select condition, variant, {share(own, "new_rank = 1")} as top_same_subject, {share(f"{own} and q_task <> c_task", "new_rank = 1")} as top_same_subject_wrong, {share("q_task <> c_task", "new_rank = 1")} as top_other_task,
            {share("fq <> fc", "new_rank = 1")} as top_other_quality, count(*) filter ({right}) as n_queries, {share("new_rank = 1", right)} as top1, round(avg(1 / new_rank) filter ({right}), 6) as mrr from ev group by condition, variant""",
    }
