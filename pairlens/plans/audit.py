"""Registered queries over candidate pools, rerankers and statistics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import pools as P
from pairlens.operators import statistics as S
from pairlens.operators.retrieval import FEATURES

ROUNDS = 200
Y = [f"y_{c}" for c in FEATURES]


def queries(pairs: Callable[[SparkSession, str], DataFrame], vectors: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def front(s, d):
        return P.pool_scores(pairs(s, d))

    def back(s, d):
        return P.pool_scores(P.reverse_pairs(pairs(s, d)))

    def new(s, d, variant):
        found = P.gated(front(s, d)) if variant == "gated" else P.cycle(front(s, d), back(s, d)) if variant == "cycle" else P.k_reciprocal(front(s, d), back(s, d))
        return found.select(*P.QUERY, *P.CANDIDATE, "new_score", "new_rank")

    def diagnosed(s, d, variant=None):
        return P.query_diagnostics(front(s, d)) if variant is None else P.query_diagnostics(new(s, d, variant), "new_score", "new_rank")

    def changes(s, d):
        return S.long_form(pairs(s, d), ["subject", "task"], Y)

    found = {
        "pool_scores": lambda s, d: front(s, d),
        "pool_diagnostics": lambda s, d: diagnosed(s, d),
        "pool_metrics": lambda s, d: P.pool_metrics(diagnosed(s, d)),
        "same_subject_negatives": lambda s, d: P.same_subject_negatives(front(s, d).where("condition = 'all'")),
        "transition_effects": lambda s, d: S.transition_effects(changes(s, d)),
        "spearman_baseline_change": lambda s, d: S.spearman(_baseline(pairs(s, d)), "x", "y", ["feature"]),
        "variance_by_task": lambda s, d: S.variance_share(changes(s, d), "task"),
        "sign_flip_null": lambda s, d: S.sign_flip(changes(s, d), ROUNDS, "subject", "task"),
        "sign_flip_discoveries": lambda s, d: S.false_discovery(S.sign_flip(changes(s, d), ROUNDS, "subject", "task"), "p_value", [], ["feature"]),
        "top1_bootstrap": lambda s, d: S.subject_bootstrap(_hits(diagnosed(s, d)), "q_subject", "hit", ROUNDS, ["condition"]),
        "complete_pair_counts": lambda s, d: _complete(vectors(s, d)),
    }
    for variant in ("gated", "cycle", "k_reciprocal"):
        found[f"rerank_{variant}"] = lambda s, d, v=variant: new(s, d, v)
        found[f"rerank_{variant}_metrics"] = lambda s, d, v=variant: P.pool_metrics(diagnosed(s, d, v))
        found[f"rerank_{variant}_changes"] = lambda s, d, v=variant: P.change_log(diagnosed(s, d), diagnosed(s, d, v))
    return found


def _baseline(pairs: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"x_{c}").alias("x"), F.col(f"y_{c}").alias("y")) for c in FEATURES]))
    return pairs.select(rows.alias("v")).select("v.*")


def _hits(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.withColumn("hit", (F.col("true_rank") == 1).cast("double"))


def _complete(vectors: DataFrame) -> DataFrame:
    """Subjects by task with both states, and with one of them only."""
    has = lambda x: F.max((F.col("state") == x).cast("int"))
    each = vectors.groupBy("subject", "task").agg(has("A").alias("off"), has("R").alias("on"))
    return each.groupBy("task").agg(F.sum((F.col("off") * F.col("on")).cast("long")).alias("n_complete"), F.sum((1 - F.col("off") * F.col("on")).cast("long")).alias("n_incomplete"))


def _distance(a: str, b: str, z: str) -> str:
    """Mean over groups of the cosine distance of columns q_* of ``a`` and c_* of ``b`` by the scale ``z``."""
    parts = []
    for g in P.GROUPS:
        x, y = [f"(({a}_{c} - {z}.m_{c}) / {z}.d_{c})" for c in g], [f"(({b}_{c} - {z}.m_{c}) / {z}.d_{c})" for c in g]
        dot, p, q = (" + ".join(f"{u} * {v}" for u, v in zip(m, n)) for m, n in ((x, y), (x, x), (y, y)))
        parts.append(f"case when sqrt({p}) * sqrt({q}) > 1e-12 then 1 - ({dot}) / (sqrt({p}) * sqrt({q})) else 1 end")
    return f"round(({' + '.join(parts)}) / {len(P.GROUPS)}, 6)"


KEY, ORDER = "condition, q_subject, q_task", "c_subject, c_task"


def ranked_both_ways(both: str) -> str:
    """``both`` and the relations after it, up to ``f``: every condition's candidates, with places in both directions."""
    key, order = KEY, ORDER
    scale = ", ".join(f"avg(o.f_{c}) as m_{c}, case when stddev_samp(o.f_{c}) >= 1e-8 then stddev_samp(o.f_{c}) else 1 end as d_{c}" for c in FEATURES)
    off, on = ", ".join(f"x_{c} as f_{c}" for c in FEATURES), ", ".join(f"x_{c} + y_{c} as f_{c}" for c in FEATURES)
    sides = ", ".join(f"q.x_{c} as qoff_{c}, c.x_{c} + c.y_{c} as con_{c}" for c in FEATURES)
    price = "round(abs((qoff_price - zq.m_price) / zq.d_price - (con_price - zq.m_price) / zq.d_price), 6)"
    return f"""{both}, st as (select subject, {off} from p union all select subject, {on} from p),
        z as (select s.subject, {scale} from (select distinct subject from p) s join st o on o.subject <> s.subject group by s.subject having count(*) > 1),
        c2 as (select q.subject as q_subject, q.task as q_task, c.subject as c_subject, c.task as c_task, {sides} from p q cross join p c),
        sc as (select q_subject, q_task, c_subject, c_task, {_distance("qoff", "con", "zq")} as score, {price} as second, {_distance("con", "qoff", "zc")} as back
            from c2 join z zq on zq.subject = q_subject join z zc on zc.subject = c_subject),
        k as (select condition, sc.* from sc join (values ('same_task'), ('same_subject_added'), ('all')) as n(condition)
            on condition = 'all' or q_task = c_task or (condition = 'same_subject_added' and q_subject = c_subject)),
        f as (select *, cast(row_number() over (partition by {key} order by score, {order}) as int) as rank, count(*) over (partition by {key}) as n_candidates,
            cast(row_number() over (partition by condition, c_subject, c_task order by back, q_subject, q_task) as int) as back_rank from k)"""


def oracle_sql(both: str, vectors: str) -> dict[str, str]:
    """``both``: a WITH clause up to the table ``p`` of pairs; ``vectors``: up to the table ``v`` of states."""
    key, order, base = KEY, ORDER, ranked_both_ways(both)
    zs = lambda x, extra="": f"(({x}) - avg({x}) over (partition by {key}{extra})) / case when stddev_pop({x}) over (partition by {key}{extra}) > 1e-9 then stddev_pop({x}) over (partition by {key}{extra}) else 1 end"
    new = {
        "gated": f"round(case when rank <= {P.TOP_K} then -({zs('-score', f', rank <= {P.TOP_K}')} + {P.SECOND_WEIGHT} * {zs('-second', f', rank <= {P.TOP_K}')}) else 1000.0 + rank end, 6)",
        "cycle": f"round({zs('score')} + {zs('back')} + case when q_task <> c_task then {P.PENALTY} + case when q_subject = c_subject then {P.PENALTY} else 0 end else 0 end, 6)",
        "k_reciprocal": f"round({zs('score')} + {zs('back')} - (case when rank <= {P.TOP_K} and back_rank <= {P.TOP_K} then 1 else 0 end + overlap), 6)",
    }
    lists = f""", lf as (select condition, q_subject, q_task, list(c_subject || '|' || c_task) as front from f where rank <= {P.TOP_K} group by all),
        lb as (select condition, c_subject, c_task, list(q_subject || '|' || q_task) as behind from f where back_rank <= {P.TOP_K} group by all),
        fk as (select f.*, round(len(list_intersect(front, behind)) * 1.0 / (len(front) + len(behind) - len(list_intersect(front, behind))), 6) as overlap from f join lf using ({key}) join lb using (condition, {order}))"""
    diagnostics = lambda table, score, rank: f"""(select {key}, n_candidates, true_rank, top_subject, top_task, round(nearest - true_score, 6) as margin, round(1.0 / true_rank, 6) as reciprocal_rank,
        round(1 - (true_rank - 1) / cast(greatest(1, n_candidates - 1) as double), 6) as percentile, round(1.0 / n_candidates, 6) as chance, case when true_rank = 1 then 'success' when top_subject = q_subject then 'same_subject_wrong_task'
        when top_task = q_task then 'other_subject_same_task' else 'other_subject_wrong_task' end as outcome from (select {key}, count(*) as n_candidates,
        max(case when q_subject = c_subject and q_task = c_task then {rank} end) as true_rank, max(case when q_subject = c_subject and q_task = c_task then {score} end) as true_score,
        min(case when q_subject <> c_subject or q_task <> c_task then {score} end) as nearest, max(case when {rank} = 1 then c_subject end) as top_subject, max(case when {rank} = 1 then c_task end) as top_task from {table} group by {key}))"""  # noqa: E731
    share = lambda x, n: f"round(avg(case when {x} then 1.0 else 0.0 end), 6) as {n}"
    measures = f"""condition, count(*) as n_queries, {", ".join(share(f"true_rank <= {k}", f"top{k}") for k in (1, 3, 5))}, round(avg(1.0 / true_rank), 6) as mrr, round(avg(percentile), 5) as percentile, round(avg(true_rank), 6) as mean_rank,
        round(quantile_cont(true_rank, 0.5), 6) as median_rank, cast(sum(case when true_rank <> 1 then 1 else 0 end) as bigint) as failures, round(avg(margin), 5) as mean_margin, {share("top_subject = q_subject", "same_subject_rate")},
        round(avg(case when top_subject = q_subject then 1.0 else 0.0 end) - avg(case when true_rank = 1 then 1.0 else 0.0 end), 6) as fingerprint_gap"""
    plain = diagnostics("f", "score", "rank")
    long = f"{both}, l as (" + " union all ".join(f"select subject, task, 'y_{c}' as feature, y_{c} as value from p" for c in FEATURES) + ")"
    draw = lambda x: f"cast('0x' || substr(md5(concat_ws('|', {x})), 1, 8) as bigint)"
    flips = f"""{long}, w as (select feature, r.round, avg(value * case when {draw("r.round, feature, subject, task")} % 2 = 0 then 1.0 else -1.0 end) as m from l, range({ROUNDS}) r(round) group by all),
        e as (select w.feature, round(first(seen), 6) as mean_delta, round((1 + sum(case when abs(m) >= abs(seen) - 1e-9 then 1 else 0 end)) / {1.0 + ROUNDS}, 6) as p_value from w join (select feature, avg(value) as seen from l group by feature) o on o.feature = w.feature group by w.feature)"""
    found = {
        "pool_scores": f"with {base} select {key}, {order}, score, second, rank, n_candidates from f",
        "pool_diagnostics": f"with {base} select * from {plain}",
        "pool_metrics": f"with {base} select {measures} from {plain} group by condition",
        "same_subject_negatives": f"""with {base}, o as (select {key}, max(case when q_task = c_task then score end) as true_score, min(case when q_task <> c_task then score end) as best_wrong,
            cast(sum(case when q_task <> c_task then 1 else 0 end) as bigint) as n_negatives from f where condition = 'all' and q_subject = c_subject group by {key}) select *, true_score <= best_wrong as success from o where n_negatives > 0""",
        "transition_effects": f"""with {long} select feature, count(*) as n, round(avg(value), 6) as mean_delta, round(quantile_cont(value, 0.5), 6) as median_delta, round(avg(value) / case when stddev_samp(value) > 1e-12 then stddev_samp(value) end, 6) as dz,
            case when avg(case when value > 0 then 1.0 else 0 end) >= avg(case when value < 0 then 1.0 else 0 end) then 'positive' else 'negative' end as direction,
            round(greatest(avg(case when value > 0 then 1.0 else 0 end), avg(case when value < 0 then 1.0 else 0 end)), 6) as sign_consistency from l group by feature""",
        "spearman_baseline_change": f"with {both}, l as (" + " union all ".join(f"select '{c}' as feature, x_{c} as x, y_{c} as y from p" for c in FEATURES)
        + """), r as (select feature, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from l)
            select feature, count(*) as n, round(corr(rx, ry), 6) as rho from r group by feature""",
        "variance_by_task": f"""with {long}, g as (select feature, task, count(*) as n, avg(value) as m from l group by all), w as (select feature, avg(value) as m, sum(power(value, 2)) - count(*) * power(avg(value), 2) as whole from l group by feature)
            select g.feature, 'task' as factor, count(*) as n_groups, round(sum(g.n * power(g.m - w.m, 2)) / first(w.whole), 6) as between_share from g join w on w.feature = g.feature group by g.feature""",
        "sign_flip_null": f"with {flips} select * from e",
        "sign_flip_discoveries": f"""with {flips}, b as (select *, row_number() over (order by p_value, feature) as place, count(*) over () as n from e)
            select feature, mean_delta, p_value, round(least(1.0, min(p_value * n / place) over (order by place desc)), 6) as q_value from b""",
        "top1_bootstrap": f"""with {base}, o as (select condition, q_subject, count(*) as n, sum(case when true_rank = 1 then 1.0 else 0.0 end) as v from {plain} group by all),
            a as (select *, row_number() over (partition by condition order by q_subject) - 1 as place, count(*) over (partition by condition) as k from o),
            m as (select d.condition, d.round, sum(a.v) / sum(a.n) as m from (select condition, r.round, {draw("r.round, place")} % k as place from a, range({ROUNDS}) r(round)) d join a on a.condition = d.condition and a.place = d.place group by all)
            select condition, count(*) as n_rounds, round(avg(m), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by condition""",
        "complete_pair_counts": f"""with {vectors}, e as (select subject, task, max(case when state = 'A' then 1 else 0 end) * max(case when state = 'R' then 1 else 0 end) as whole from v group by all)
            select task, cast(sum(whole) as bigint) as n_complete, cast(sum(1 - whole) as bigint) as n_incomplete from e group by task""",
    }
    for variant, score in new.items():
        table = "fk" if variant == "k_reciprocal" else "f"
        clause = f"{base}{lists if variant == 'k_reciprocal' else ''}, s as (select *, {score} as new_score from {table}), t as (select *, cast(row_number() over (partition by {key} order by new_score, {order}) as int) as new_rank from s)"
        after = diagnostics("t", "new_score", "new_rank")
        found[f"rerank_{variant}"] = f"with {clause} select {key}, {order}, new_score, new_rank from t"
        found[f"rerank_{variant}_metrics"] = f"with {clause} select {measures} from {after} group by condition"
        found[f"rerank_{variant}_changes"] = f"""with {clause} select {key}, a.true_rank as rank_before, b.true_rank as rank_after, case when a.true_rank = 1 and b.true_rank = 1 then 'kept_success' when a.true_rank = 1 then 'lost'
            when b.true_rank = 1 then 'gained' else 'kept_failure' end as change, a.true_rank - b.true_rank as improvement from {plain} a join {after} b using ({key})"""
    return found
