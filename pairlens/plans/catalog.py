"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlens.operators import retrieval as R
from pairlens.plans import audit, book, checks, cohort, evidence, models

FLAGSHIP = "retrieval_summary"
#: Relations of the templates that are queries of their own.
NAMED = [*cohort.QUERIES, *evidence.QUERIES]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked_candidates(R.pairs(_vectors(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return audit.queries(lambda s, d: R.pairs(_vectors(s, d)), _vectors) | {
        "retrieval_state_vectors": _vectors,
        "retrieval_pairs": lambda s, d: R.pairs(_vectors(s, d)),
        "retrieval_candidates": _ranked,
        "retrieval_summary": lambda s, d: R.metrics(_ranked(s, d)),
        "retrieval_by_task": lambda s, d: R.metrics(_ranked(s, d), "task"),
        "retrieval_diagnostics": lambda s, d: R.diagnostics(_ranked(s, d)),
        "retrieval_subject_left_out": lambda s, d: R.subject_left_out(_ranked(s, d)),
    } | {n: lambda s, d, n=n: book.run(s, d, n, evidence.BOOK) for n in NAMED} | models.queries() | checks.queries()


def oracle_sql() -> dict[str, str]:
    f = R.FEATURES
    vectors = """v as (select s_nationkey as subject, l_linestatus as task, l_returnflag as state, count(*) as n_rows, round(avg(l_quantity), 8) as quantity,
        round(avg(l_extendedprice), 8) as price, round(avg(l_discount), 8) as discount, round(avg(l_tax), 8) as tax
        from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag in ('A', 'R') group by all)"""
    both = f"{vectors}, p as (select a.subject, a.task, " + ", ".join(f"a.{c} as x_{c}" for c in f) + ", " + ", ".join(f"round(r.{c} - a.{c}, 8) as y_{c}" for c in f) + " from v a join v r on a.subject = r.subject and a.task = r.task where a.state = 'A' and r.state = 'R')"
    off, on = ", ".join(f"x_{c} as f_{c}" for c in f), ", ".join(f"x_{c} + y_{c} as f_{c}" for c in f)
    scale = f"st as (select subject, {off} from p union all select subject, {on} from p), z as (select q.subject, " + ", ".join(f"case when stddev_samp(o.f_{c}) >= 1e-8 then stddev_samp(o.f_{c}) else 1 end as sd_{c}" for c in f) + " from (select distinct subject from p) q join st o on o.subject <> q.subject group by q.subject having count(*) > 1)"
    distance = " + ".join(f"pow((q.x_{c} - (c.x_{c} + c.y_{c})) / z.sd_{c}, 2)" for c in f)
    ranked = f"{both}, {scale}, s as (select q.task, q.subject as query, c.subject as candidate, round(sqrt({distance}), 6) as score from p q join z on z.subject = q.subject join p c on c.task = q.task), k as (select *, cast(row_number() over (partition by task, query order by score, candidate) as int) as rank, query = candidate as is_true from s)"
    measures = "count(*) as n_queries, round(avg(case when rank = 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as top3, round(avg(1.0 / rank), 6) as mrr, round(avg(rank), 6) as mean_rank"
    return models.oracle_sql() | checks.oracle_sql(audit.ranked_both_ways(both), both) | audit.oracle_sql(both, vectors) | {n: book.render(n, evidence.BOOK, False) for n in NAMED} | {
        "retrieval_state_vectors": f"with {vectors} select * from v",
        "retrieval_pairs": f"with {both} select * from p",
        "retrieval_candidates": f"with {ranked} select * from k",
        "retrieval_summary": f"with {ranked} select {measures} from k where is_true",
        "retrieval_by_task": f"with {ranked} select task, {measures} from k where is_true group by task",
        "retrieval_diagnostics": f"with {ranked}, d as (select task, query, count(*) as n_candidates, min(rank) filter (is_true) as true_rank, min(score) filter (is_true) as true_score, min(score) filter (not is_true) as best_wrong from k group by all) select *, round(best_wrong - true_score, 6) as margin from d",
        "retrieval_subject_left_out": f"with {ranked}, t as (select * from k where is_true) select q.query as subject, count(*) as n_queries, round(avg(case when o.rank = 1 then 1.0 else 0.0 end), 6) as top1, round(avg(1.0 / o.rank), 6) as mrr from (select distinct query from t) q join t o on o.query <> q.query group by q.query",
    }
