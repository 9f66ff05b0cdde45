"""Queries of spectra, fold models and rankers over the given tables, with SQL that reaches the results by another route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.operators import folds as L
from pairlens.operators import graphs as G
from pairlens.operators import permutations as P
from pairlens.operators import ranker as K
from pairlens.operators import retrieval as R
from pairlens.operators import robust as H
from pairlens.operators import spectra as S
from pairlens.operators import windows as W

RATE, STEP = 100.0, 600
#: What orders are predicted from, and what they are freed of.
FEATURES = ["n_lines", "quantity", "price", "discount", "balance"]
FACTORS, FREED = ["priority", "status", "segment"], ["total", "quantity", "price", "discount"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Event values in steps of ten minutes, a channel an event type; a step counts as a hundredth of a second."""
    return S.sampled(_table(spark, d, "events"), "event_type", "ts", "value", STEP)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def orders_of(spark: SparkSession, d: str) -> DataFrame:
    """A row an order that has lines: its customer's nation as subject, total, means of its lines; a balance below 0 is missing."""
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("n_lines"), *(F.round(F.avg(c), 8).alias(n) for n, c in names.items()))
    whole = _table(spark, d, "orders").join(_table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(lines, "o_orderkey")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    return whole.select("o_orderkey", F.col("c_nationkey").alias("subject"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), "n_lines", *names, balance)


def _ridge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return L.ridge(orders_of(spark, d), "subject", "total", FEATURES)


def _ridge_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ridge(spark, d)[0].select("o_orderkey", "subject", "total", "y_pred", "fold_status"), 2)


def _ridge_weights(spark: SparkSession, d: str) -> DataFrame:
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), F.col("weights").alias("weight"), F.col("fills").alias("fill"))).alias("e")
    return _rounded(_ridge(spark, d)[1].where("fold_status = 'ok'").select("subject", "n", named).select("subject", "n", "e.feature", "e.weight", "e.fill"), 4)


def _ridge_metrics(spark: SparkSession, d: str) -> DataFrame:
    ok, error = _ridge(spark, d)[0].where("fold_status = 'ok'"), F.col("y_pred") - F.col("total")
    return ok.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 3).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 3).alias("rmse"), F.round(F.corr("y_pred", "total"), 5).alias("pearson"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.residuals(orders_of(spark, d), "subject", FACTORS, FREED).select("o_orderkey", "subject", *(f"r_{f}" for f in FREED)), 5)


def _scores(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Distances of every off state from the on states of its task, by the metric that the other subjects' states give."""
    pairs = R.pairs(R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier"))).withColumn("id", F.concat_ws("|", "subject", "task"))
    off = pairs.select("id", "subject", "task", *(F.col(f"x_{c}").alias(c) for c in R.FEATURES))
    on = pairs.select("id", "subject", "task", *((F.col(f"x_{c}") + F.col(f"y_{c}")).alias(c) for c in R.FEATURES))
    metrics = L.fold_metrics(off.unionByName(on), "subject", list(R.FEATURES), kind)
    return _rounded(L.metric_scores(off, on, metrics, "subject", ["task"], list(R.FEATURES)))


def _metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval metrics of each kind of fold metric."""
    out = None
    for kind in L.KINDS:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "candidate"))
        ranked = _scores(spark, d, kind).withColumn("rank", rank).withColumn("is_true", F.col("query") == F.col("candidate"))
        one = R.metrics(ranked, "task").withColumn("metric", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


RANKED = [*(f"gap_{c}" for c in R.FEATURES), "mahalanobis"]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every off state with the on states of its task: gaps of the features and Mahalanobis distance; ``is_true``: the same subject's."""
    pairs = R.pairs(R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier"))).withColumn("id", F.concat_ws("|", "subject", "task"))
    off = pairs.select(F.col("id").alias("query"), *(F.col(f"x_{c}").alias(f"q_{c}") for c in R.FEATURES))
    on = pairs.select(F.col("id").alias("candidate"), *((F.col(f"x_{c}") + F.col(f"y_{c}")).alias(f"c_{c}") for c in R.FEATURES))
    met = _scores(spark, d, "mahalanobis").withColumnRenamed("score", "mahalanobis").join(off, "query").join(on, "candidate")
    return met.select("task", "query", "candidate", (F.col("query") == F.col("candidate")).alias("is_true"), *(F.abs(F.col(f"q_{c}") - F.col(f"c_{c}")).alias(f"gap_{c}") for c in R.FEATURES), "mahalanobis")


def _ranker_coefficients(spark: SparkSession, d: str) -> DataFrame:
    k = K.fit_ranker(_candidates(spark, d).where("task = 'F'"), "is_true", RANKED)
    rows = [("intercept", None, None, None, k.intercept), *zip(k.features, k.fills, k.means, k.scales, k.coefficients)]
    return _rounded(spark.createDataFrame(rows, "feature string, fill double, mean double, scale double, coefficient double"), 5)


def _ranker_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ranker of task F, frozen, over the candidates of task O."""
    rows = _candidates(spark, d)
    frozen = K.fit_ranker(rows.where("task = 'F'"), "is_true", RANKED)
    return _rounded(K.apply_ranker(rows.where("task = 'O'"), frozen, "query", "candidate").select("query", "candidate", "is_true", "linear", "probability"), 5)


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """A recording a customer, of a hundredth of its balance in hours; those of even nations are of clicks."""
    default = F.when(F.col("c_nationkey") % 2 == 0, "click").otherwise("unknown")
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("recording"), F.round(F.abs("c_acctbal") / 100, 4).alias("duration"), default.alias("default_condition"))


def _user_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals of their user's recording: hours of the month modulo 100, value as hours; errors are bad."""
    hours = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")) % 360000 / 3600
    condition = F.when(F.col("event_type") == "error", "BAD_error").otherwise(F.col("event_type"))
    return _table(spark, d, "events").select(F.col("user_id").alias("recording"), F.round(hours, 4).alias("onset"), F.col("value").alias("duration"), condition.alias("condition"), "event_id")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return W.event_windows(_user_events(spark, d), _recordings(spark, d), max_windows=20, max_duration=30.0, fixed=10.0, order=("onset", "event_id"))


def _window_samples(spark: SparkSession, d: str) -> DataFrame:
    samples = _user_events(spark, d).select("recording", F.col("onset").alias("at"), F.col("duration").alias("value"))
    held = W.in_windows(samples, _windows(spark, d), 10.0)
    return held.groupBy("recording", "onset", "duration", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _huber(spark: SparkSession, d: str) -> DataFrame:
    """A line of order totals on customers' balances, a nation each."""
    return _rounded(H.huber_slopes(orders_of(spark, d), ["subject"], "balance", "total"), 3)


def _laplacian(spark: SparkSession, d: str) -> DataFrame:
    """A nation's graph: its customers' segments, and the priorities of their orders, weighed by hundreds of orders."""
    orders = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return G.laplacian_spectra(orders.select(F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b"), F.lit(0.01).alias("weight")), "subject", 5)


def _deviation(spark: SparkSession, d: str) -> DataFrame:
    spectra = _laplacian(spark, d)
    return _rounded(G.spectral_deviation(spectra, spectra, "subject").where("left < right"))


HOURS = 4
KINDS = ["click", "error", "purchase", "signup", "view"]


def _bipolar(spark: SparkSession, d: str) -> DataFrame:
    """Differences of neighbouring event types' totals in steps of four hours, where both have events; a recording a region."""
    region = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("recording"))
    contact = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int").alias("contact")
    n = F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")) / F.lit(3600 * HOURS)).alias("n")
    totals = _table(spark, d, "events").join(region, "user_id").groupBy("recording", contact, n).agg(F.sum("value").alias("value"))
    low, high = totals.select("recording", "n", F.col("contact").alias("lo"), F.col("value").alias("v")), totals.select("recording", "n", F.col("contact").alias("hi"), F.col("value").alias("w"))
    return low.join(high, ["recording", "n"]).where("hi = lo + 1").select("recording", "lo", "hi", "n", (F.col("v") - F.col("w")).alias("value"))


def _montage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Differences of event types that are not neighbours, along the chain of those that are."""
    signals = _bipolar(spark, d)
    edges = signals.select("recording", "lo", "hi", F.col("lo").alias("at")).distinct()
    targets = edges.select("recording").distinct().select("recording", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 3), (1, 5), (4, 2))))).alias("t")).select("recording", "t.*")
    return G.reconstructed(signals, G.edge_paths(edges, targets))


PERMUTED = 5000


def _permutations(spark: SparkSession, d: str) -> DataFrame:
    """Whether off states foretell changes of quantity: subjects' changes dealt to one another in each round."""
    pairs = R.pairs(R.state_vectors(_table(spark, d, "lineitem"), _table(spark, d, "supplier")))
    return P.permuted_ridge(pairs, "subject", "task", "y_quantity", [f"x_{c}" for c in R.FEATURES], PERMUTED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "welch_spectra": lambda s, d: _rounded(S.welch(_series(s, d), RATE)),
        "welch_band_powers": lambda s, d: _rounded(S.band_powers(S.welch(_series(s, d), RATE), S.BANDS | S.gamma_band(RATE))),
        "coherence_spectra": lambda s, d: _rounded(S.coherence(_series(s, d), RATE)),
        "band_coherences": lambda s, d: _rounded(S.band_coherence(S.coherence(_series(s, d), RATE), S.COUPLING_BANDS)),
        "ridge_predictions": _ridge_predictions,
        "ridge_weights": _ridge_weights,
        "ridge_metrics": _ridge_metrics,
        "factor_residuals": _residuals,
        "mahalanobis_scores": lambda s, d: _scores(s, d, "mahalanobis"),
        "subject_component_scores": lambda s, d: _scores(s, d, "components"),
        "low_rank_scores": lambda s, d: _scores(s, d, "low_rank"),
        "fold_metric_summary": _metric_summary,
        "ranker_coefficients": _ranker_coefficients,
        "ranker_scores": _ranker_scores,
        "event_windows": lambda s, d: _rounded(_windows(s, d)),
        "window_samples": _window_samples,
        "huber_slopes": _huber,
        "subject_permutation_null": lambda s, d: _rounded(P.null_summary(_permutations(s, d))),
        "laplacian_spectra": lambda s, d: _rounded(_laplacian(s, d)),
        "spectral_deviations": _deviation,
        "montage_signals": lambda s, d: _rounded(_montage(s, d)[0], 4),
        "montage_provenance": lambda s, d: _montage(s, d)[1],
    }


#: Samples of each channel and the plain Fourier sums of their segments, term by term.
_SAMPLES = f"""series as materialized (select event_type as channel, step - min(step) over () as n, value from
    (select event_type, epoch_us(ts) // {STEP * 1_000_000} as step, avg(value) as value from events where event_type is not null and ts is not null and value is not null and not isnan(value) group by all)),
    sizes as materialized (select channel, max(n) + 1 as size from series group by channel)"""


def _fourier(width: str, least: int) -> str:
    return f"""{_SAMPLES}, widths as (select channel, size, cast({width} as bigint) as width, cast({width} as bigint) - cast({width} as bigint) // 2 as hop from sizes where size >= {least}),
    starts as (select *, unnest(range((size - width) // hop + 1)) as segment from widths),
    parts as (select s.channel, segment, width, n - segment * hop as place, value - avg(value) over (partition by s.channel, segment) as value from starts s join series x on x.channel = s.channel and n >= segment * hop and n < segment * hop + width),
    tapered as (select *, value * (0.5 - 0.5 * cos(2 * pi() * place / width)) as v from parts),
    sums as materialized (select channel, segment, width, k, sum(v * cos(2 * pi() * (k * place % width) / width)) as re, sum(-v * sin(2 * pi() * (k * place % width) / width)) as im
        from (select *, unnest(range(width // 2 + 1)) as k from tapered) group by all)"""


_WELCH = f"""with {_fourier("least(4096, greatest(256, size // 8), size)", 128)},
    counts as (select channel, count(*) as n from starts group by channel),
    spectra as (select channel, k * {RATE} / width as frequency, sum(re * re + im * im) / any_value(n) / ({RATE} * width * 0.375) * case when k = 0 or 2 * k = width then 1 else 2 end as power from sums join counts using (channel) group by channel, k, width)"""
_COHERENCE = f"""with {_fourier(f"least(size, {int(max(RATE * 2, 32))})", 8)},
    spectra as (select a.channel as left, b.channel as right, a.k * {RATE} / a.width as frequency, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) / nullif(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im), 0) as coherence
        from sums a join sums b on a.segment = b.segment and a.k = b.k and a.channel < b.channel group by a.channel, b.channel, a.k, a.width)"""


def _bands(bands: dict[str, tuple[float, float]]) -> str:
    return "(values " + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in bands.items()) + ") t(band, low, high)"


_ORDERS = """rows as materialized (select o_orderkey, c_nationkey as subject, o_totalprice as total, o_orderpriority as priority, o_orderstatus as status, c_mktsegment as segment, n_lines, quantity, price, discount, case when c_acctbal >= 0 then c_acctbal end as balance
    from orders join customer on o_custkey = c_custkey join (select l_orderkey, cast(count(*) as double) as n_lines, round(avg(l_quantity), 8) as quantity, round(avg(l_extendedprice), 8) as price, round(avg(l_discount), 8) as discount from lineitem group by 1) on o_orderkey = l_orderkey),
    train as (select f.subject as fold, r.* from (select distinct subject from rows) f join rows r on r.subject <> f.subject)"""


def _products(left: list[str], right: list[str], first: int) -> str:
    """Entries (i, j, v) of sums of products, as a list to unnest; the right side's columns begin at ``first``."""
    return ", ".join(f"{{'i': {i}, 'j': {j}, 'v': sum(({a}) * ({b}))}}" for i, a in enumerate(left, 1) for j, b in enumerate(right, first))


def _eliminated(source: str, n: int, name: str = "e") -> str:
    """Gauss-Jordan elimination of (fold, i, j, v), a relation a pivot; ``<name><n>`` has the solutions right of column n."""
    text, last = "", source
    for k in range(1, n + 1):
        text += f""", {name}{k} as materialized (select a.fold, a.i, a.j, case when a.i = {k} then a.v / p.v else a.v - c.v * r.v / p.v end as v from {last} a join {last} p on p.fold = a.fold and p.i = {k} and p.j = {k}
            join {last} c on c.fold = a.fold and c.i = a.i and c.j = {k} join {last} r on r.fold = a.fold and r.i = {k} and r.j = a.j)"""
        last = f"{name}{k}"
    return text


def _refitted() -> str:
    """Every fold's ridge regression from its own rows."""
    p = len(FEATURES)
    stats = ", ".join(f"coalesce(median({f}), 0) as f{i}, avg({f}) as m{i}" for i, f in enumerate(FEATURES))
    spread = ", ".join(f"stddev_pop(coalesce({f}, f{i})) as s{i}" for i, f in enumerate(FEATURES))
    z = [f"(coalesce({f}, f{i}) - m{i}) / (case when s{i} = 0 then 1 else s{i} end)" for i, f in enumerate(FEATURES)]
    return f"""with {_ORDERS}, st as materialized (select fold, count(*) as n, avg(total) as ym, {stats} from train group by fold), sp as materialized (select fold, {spread} from train join st using (fold) group by fold),
        g as (select fold, unnest([{_products(z, z, 1)}, {_products(z, ["total - ym"], p + 1)}]) as e from train join st using (fold) join sp using (fold) group by fold),
        a as materialized (select fold, e.i as i, e.j as j, e.v + case when e.i = e.j then 1 else 0 end as v from g){_eliminated("a", p)},
        w as materialized (select fold, {", ".join(f"max(case when i = {i} then v end) as w{i - 1}" for i in range(1, p + 1))} from e{p} where j = {p + 1} group by fold),
        pred as (select o_orderkey, subject, priority, total, ym + {" + ".join(f"w{i} * {x}" for i, x in enumerate(z))} as y_pred from rows join st on st.fold = subject join sp on sp.fold = subject join w on w.fold = subject)"""


def _freed() -> str:
    """Every fold's least squares on the factors, the first level of each left out."""
    sizes = {"priority": 5, "status": 3, "segment": 5}
    level = ", ".join(f"dense_rank() over (order by {f}) as l_{f}" for f in FACTORS)
    design = ["1", *(f"case when l_{f} = {k} then 1 else 0 end" for f in FACTORS for k in range(2, sizes[f] + 1))]
    n = len(design)
    fitted = [" + ".join(f"({x}) * v{i}_{t}" for i, x in enumerate(design, 1)) for t in range(len(FREED))]
    wide = ", ".join(f"max(case when i = {i} and j = {n + 1 + t} then v end) as v{i}_{t}" for i in range(1, n + 1) for t in range(len(FREED)))
    text = _ORDERS.replace("rows as materialized", "raw as materialized").replace("    train as", f"    rows as materialized (select *, {level} from raw),\n    train as")
    return f"""with {text}, g as (select fold, unnest([{_products(design, design, 1)}, {_products(design, FREED, n + 1)}]) as e from train group by fold), a as materialized (select fold, e.i as i, e.j as j, e.v as v from g){_eliminated("a", n)},
        w as materialized (select fold, {wide} from e{n} group by fold) select o_orderkey, subject, {", ".join(f"round({f} - ({fitted[t]}), 5) as r_{f}" for t, f in enumerate(FREED))} from rows join w on fold = subject"""


def _mahalanobis() -> str:
    """Every fold's inverse covariance from its own states."""
    f, n = R.FEATURES, len(R.FEATURES)
    identity = ", ".join(f"{{'i': {i}, 'j': {n + j}, 'v': {float(i == j)}}}" for i in range(1, n + 1) for j in range(1, n + 1))
    cov = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': covar_samp({a}, {b}) / (case when stddev_samp({a}) < 1e-8 then 1 else stddev_samp({a}) end) / (case when stddev_samp({b}) < 1e-8 then 1 else stddev_samp({b}) end) + {0.1 if i == j else 0.0}}}" for i, a in enumerate(f, 1) for j, b in enumerate(f, 1))
    means = ", ".join(f"round(avg({c}), 8) as {n}" for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")))
    gaps = ", ".join(f"(q.{c} - c.{c}) / (case when sd_{c} < 1e-8 then 1 else sd_{c} end)" for c in f)
    return f"""with v as materialized (select s_nationkey as subject, l_linestatus as task, l_returnflag as state, {means} from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag in ('A', 'R') group by all),
        s as materialized (select *, subject || '|' || task as id from v where (subject, task) in (select (subject, task) from v group by subject, task having count(*) = 2)),
        train as (select k.subject as fold, s.* from (select distinct subject from s) k join s on s.subject <> k.subject),
        a as materialized (select fold, e.i as i, e.j as j, cast(e.v as double) as v from (select fold, unnest([{cov}, {identity}]) as e from train group by fold)){_eliminated("a", n)},
        sd as (select fold, {", ".join(f"stddev_samp({c}) as sd_{c}" for c in f)} from train group by fold),
        d as (select q.subject, q.task, q.id as query, c.id as candidate, [{gaps}] as gap from s q join s c on c.task = q.task join sd on sd.fold = q.subject where q.state = 'A' and c.state = 'R')
        select task, query, candidate, round(sqrt(sum(gap[i] * v * gap[j - {n}])), 6) as score from d join e{n} on fold = subject and j > {n} group by task, query, candidate"""


def _rotated(source: str, n: int, sweeps: int = 8) -> str:
    """Jacobi's rotations of symmetric matrices (fold, a<i>_<j> for i <= j): ``j<last>`` has eigenvalues a<i>_<i> and vectors v<i>_<k>."""
    a = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    text = f", j0 as materialized (select *, {', '.join(f'{float(i == k)}::double as v{i}_{k}' for i in range(n) for k in range(n))} from {source})"
    step = 0
    for p, q in [(p, q) for _ in range(sweeps) for p in range(n) for q in range(p + 1, n)]:
        angle = f"case when abs({a(p, q)}) < 1e-300 then 0 else 0.5 * atan2(2 * {a(p, q)}, {a(q, q)} - {a(p, p)}) end"
        new = [f"c * c * {a(p, p)} - 2 * c * s * {a(p, q)} + s * s * {a(q, q)} as {a(p, p)}", f"s * s * {a(p, p)} + 2 * c * s * {a(p, q)} + c * c * {a(q, q)} as {a(q, q)}", f"0.0::double as {a(p, q)}"]
        for k in range(n):
            if k not in (p, q):
                new += [f"c * {a(p, k)} - s * {a(q, k)} as {a(p, k)}", f"s * {a(p, k)} + c * {a(q, k)} as {a(q, k)}"]
            new += [f"c * v{k}_{p} - s * v{k}_{q} as v{k}_{p}", f"s * v{k}_{p} + c * v{k}_{q} as v{k}_{q}"]
        changed = {x.rsplit(" as ", 1)[1]: x for x in new}
        every = [f"a{i}_{k}" for i in range(n) for k in range(i, n)] + [f"v{i}_{k}" for i in range(n) for k in range(n)]
        text += f", j{step + 1} as materialized (select fold, {', '.join(changed.get(x, x) for x in every)} from (select *, cos(t) as c, sin(t) as s from (select *, {angle} as t from j{step})))"
        step += 1
    return text + f", eigen as (select * from j{step})"


def _eigen_scores(kind: str) -> str:
    """Distances by directions of the folds' own states: all, shrunk (low_rank), or without the two in which subjects' means differ most."""
    f, n = R.FEATURES, len(R.FEATURES)
    states = _mahalanobis().partition("a as materialized")[0]
    gaps = _mahalanobis().partition("sd as (")[2].partition("select task, query")[0]
    sd = {c: f"(case when stddev_samp({c}) < 1e-8 then 1 else stddev_samp({c}) end)" for c in f}
    if kind == "low_rank":
        matrix = ", ".join(f"covar_samp({f[i]}, {f[k]}) / {sd[f[i]]} / {sd[f[k]]} as a{i}_{k}" for i in range(n) for k in range(i, n))
        source = f"m as (select fold, {matrix} from train group by fold)"
        mean = " + ".join(f"greatest(a{k}_{k}, 1e-6)" for k in range(n))
        terms = [f"pow({' + '.join(f'v{i}_{k} * gap[{i + 1}]' for i in range(n))}, 2) / (0.75 * greatest(a{k}_{k}, 1e-6) + 0.25 * ({mean}) / {n})" for k in range(n)]
    else:
        scatter = ", ".join(f"covar_pop(s.m_{f[i]}, s.m_{f[k]}) * count(*) / any_value(d.d_{f[i]}) / any_value(d.d_{f[k]}) as a{i}_{k}" for i in range(n) for k in range(i, n))
        source = f"""own as (select fold, subject, {', '.join(f'avg({c}) as m_{c}' for c in f)} from train group by fold, subject), dv as (select fold, {', '.join(f'{sd[c]} as d_{c}' for c in f)} from train group by fold),
            m as (select s.fold, {scatter} from own s join dv d on d.fold = s.fold group by s.fold)"""
        larger = lambda k: " + ".join(f"case when a{i}_{i} > a{k}_{k} then 1 else 0 end" for i in range(n) if i != k)
        terms = [f"case when {larger(k)} < 2 then 0 else pow({' + '.join(f'v{i}_{k} * gap[{i + 1}]' for i in range(n))}, 2) end" for k in range(n)]
    return f"{states} {source}{_rotated('m', n)}, sd as ({gaps} select task, query, candidate, round(sqrt({' + '.join(terms)}), 6) as score from d join eigen on eigen.fold = d.subject"


def _newton(rounds: int = 12) -> str:
    """The ranker's coefficients ``b<rounds>`` (w0: intercept) by Newton's steps, one elimination a step."""
    p = len(RANKED)
    text = _mahalanobis().rpartition("select task, query")[0]
    gaps = ", ".join(f"abs(q.{c} - c.{c}) as gap_{c}" for c in R.FEATURES)
    text += f""", sc as materialized (select task, query, candidate, round(sqrt(sum(gap[i] * v * gap[j - {len(R.FEATURES)}])), 6) as mahalanobis from d join e{len(R.FEATURES)} on fold = subject and j > {len(R.FEATURES)} group by task, query, candidate),
        cand as materialized (select sc.task, query, candidate, query = candidate as is_true, {gaps}, mahalanobis from sc join s q on q.id = query and q.state = 'A' join s c on c.id = candidate and c.state = 'R'),
        fit as materialized (select {", ".join(f"median({f}) as fill_{f}, avg({f}) as mean_{f}, stddev_pop({f}) as scale_{f}" for f in RANKED)}, count(*) as n, count(*) filter (is_true) as ones from cand where task = 'F'),
        z as materialized (select 0 as fold, case when is_true then 1 else 0 end as y, case when is_true then n / (2.0 * ones) else n / (2.0 * (n - ones)) end as w, 1.0::double as z0, {", ".join(f"({f} - mean_{f}) / scale_{f} as z{i}" for i, f in enumerate(RANKED, 1))} from cand, fit where task = 'F'),
        b0 as (select {", ".join(f"0.0::double as w{i}" for i in range(p + 1))})"""
    z = [f"z{i}" for i in range(p + 1)]
    for k in range(rounds):
        linear = " + ".join(f"w{i} * z{i}" for i in range(p + 1))
        penalty = " + ".join(["0.0", *(f"case when i = {i} and j = {p + 2} then w{i - 1} when i = {i} and j = {i} then 1 else 0 end" for i in range(2, p + 2))])
        text += f""", p{k} as materialized (select z.*, 1 / (1 + exp(-({linear}))) as p from z, b{k}),
        h{k} as (select fold, unnest([{_products([f"w * p * (1 - p) * {x}" for x in z], z, 1)}, {_products(z, ["w * (p - y)"], p + 2)}]) as e from p{k} group by fold),
        g{k} as materialized (select fold, e.i as i, e.j as j, e.v + (select {penalty} from b{k}) as v from (select fold, e, e.i as i, e.j as j from h{k})){_eliminated(f"g{k}", p + 1, f"n{k}_")},
        b{k + 1} as materialized (select {", ".join(f"w{i - 1} - max(case when i = {i} then v end) as w{i - 1}" for i in range(1, p + 2))} from n{k}_{p + 1}, b{k} where j = {p + 2} group by {', '.join(f'w{i}' for i in range(p + 1))})"""
    return text


_CLIPPED = """r as (select c_custkey as recording, round(abs(c_acctbal) / 100, 4) as stop, case when c_nationkey % 2 = 0 then 'click' else 'unknown' end as usual from customer),
    ev as (select user_id as recording, round(epoch_us(ts - timestamp '2024-01-01 00:00:00') // 1000000 % 360000 / 3600, 4) as onset, value as duration, case when event_type = 'error' then 'BAD_error' else event_type end as condition, event_id from events),
    ok as (select *, condition not ilike 'bad%' as good, condition not ilike 'bad%' and usual <> 'unknown' and contains(lower(condition), usual) as hinted from ev join r using (recording) where duration > 0 and onset >= 0 and onset < stop),
    picked as (select * from ok o where case when exists (from ok x where x.recording = o.recording and x.hinted) then hinted when exists (from ok x where x.recording = o.recording and x.good) then good else true end),
    w as materialized (select recording, onset, least(duration, 30.0) as duration, condition, 'events' as source from (select *, row_number() over (partition by recording order by onset, event_id) as i from picked) where i <= 20
        union all select recording, i * 10.0, least(10.0, least(stop, 30.0) - i * 10.0), usual, 'fixed_window_fallback' from (select *, unnest(range(cast(least(20, greatest(1, floor(least(stop, 30.0) / 10.0))) as bigint))) as i from r where stop > 0 and recording not in (select recording from ok)))"""


def _reweighted(rounds: int = 60) -> str:
    """Huber lines by reweighted least squares, a relation a round."""
    text = f"""with {_ORDERS}, st as (select subject, count(*) as n, avg(balance) as mx, stddev_pop(balance) as sx, avg(total) as my, stddev_pop(total) as sy from rows where balance is not null group by subject),
        z as materialized (select subject, (balance - mx) / sx as z, total as y from rows join st using (subject) where balance is not null),
        h0 as (select subject, 0.0::double as w, my as b, sy as s from st)"""
    for k in range(rounds):
        text += f""", r{k} as (select *, y - w * z - b as e, case when abs(y - w * z - b) > 1.35 * s then 1.35 * s / abs(y - w * z - b) else 1 end as k from z join h{k} using (subject)),
        q{k} as (select subject, any_value(s) as s, sum(k * z * z) + 1e-4 * any_value(s) as a, sum(k * z) as c, sum(k) as d, sum(k * z * y) as f, sum(k * y) as g, sqrt(sum(e * e) filter (k = 1) / (count(*) - 1.8225 * count(*) filter (k < 1))) as t from r{k} group by subject),
        h{k + 1} as materialized (select subject, (f * d - c * g) / (a * d - c * c) as w, (a * g - c * f) / (a * d - c * c) as b, t as s from q{k})"""
    return text + f" select subject, n, round(w, 3) as slope, round(b, 3) as intercept, 'ok' as status from h{rounds} join st using (subject)"


_CHAIN = """t as (select n_regionkey as recording, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) as c, epoch_us(ts - timestamp '2024-01-01 00:00:00') // 1000000 // 14400 as n, sum(value) as v from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey group by all),
    ends as (select recording, c, max(n) + 1 as size from (select x.recording, x.c, x.n from t x join t y on y.recording = x.recording and y.n = x.n and y.c = x.c + 1) group by all),
    goals as (select r.recording, unnest([{'a': 1, 'b': 3}, {'a': 1, 'b': 5}, {'a': 4, 'b': 2}], recursive := true) from (select distinct recording from t) r),
    whole as (select g.recording, a, b, abs(a - b) as path_length, min(size) as size from goals g join ends e on e.recording = g.recording and c >= least(a, b) and c < greatest(a, b) group by all having count(*) = abs(a - b))"""


def _dealt() -> str:
    """Every round's folds refitted from their own rows."""
    p = len(R.FEATURES)
    means = ", ".join(f"round(avg({c}), 8) as {n}" for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")))
    x = list(R.FEATURES)
    z = [f"({f} - m_{f}) / s_{f}" for f in x]
    return f"""with v as materialized (select s_nationkey as subject, l_linestatus as task, l_returnflag as state, {means} from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag in ('A', 'R') group by all),
        t as materialized (select a.*, round(r.quantity - a.quantity, 8) as y from v a join v r on r.subject = a.subject and r.task = a.task where a.state = 'A' and r.state = 'R'),
        o as (select subject, round, row_number() over (partition by round order by subject) as i, row_number() over (partition by round order by case when round = 0 then subject else cast('0x' || substr(md5(round || '|' || subject), 1, 8) as bigint) end, subject) as j from (select distinct subject from t), (select unnest(range({PERMUTED + 1})) as round)),
        k as materialized (select a.round, a.subject, t.task, {", ".join(f"t.{f}" for f in x)}, y.y from o a join o b on b.round = a.round and b.j = a.i join t on t.subject = a.subject join t y on y.subject = b.subject and y.task = t.task),
        tr as (select h.round, h.subject as held, k.* exclude (round, subject) from (select distinct round, subject from k) h join k on k.round = h.round and k.subject <> h.subject),
        st as materialized (select round * 100 + held as fold, round, held, avg(y) as ym, {", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in x)} from tr group by all having count(*) >= 8),
        g as (select fold, unnest([{_products(z, z, 1)}, {_products(z, ["y - ym"], p + 1)}]) as e from tr join st on st.fold = tr.round * 100 + tr.held group by fold),
        a as materialized (select fold, e.i as i, e.j as j, e.v + case when e.i = e.j then 1 else 0 end as v from g){_eliminated("a", p)},
        w as (select fold, {", ".join(f"max(case when i = {i} then v end) as w{i}" for i in range(1, p + 1))} from e{p} where j = {p + 1} group by fold),
        pr as (select k.round, y, ym + {" + ".join(f"w{i} * {c}" for i, c in enumerate(z, 1))} as pred from k join st on st.round = k.round and held = subject join w on w.fold = st.fold),
        rk as (select round, rank() over (partition by round order by y) + (count(*) over (partition by round, y) - 1) / 2 as ry, rank() over (partition by round order by pred) + (count(*) over (partition by round, pred) - 1) / 2 as rp from pr),
        s as materialized (select round, corr(ry, rp) as spearman from rk group by round)
        select count(*) as n_rounds, round(any_value(observed), 6) as observed, round(avg(spearman), 6) as null_mean, round((1 + count(*) filter (spearman >= observed - 1e-12)) / (1 + count(*)), 6) as p_value from s, (select spearman as observed from s where round = 0) where round > 0"""


def oracle_sql() -> dict[str, str]:
    last = 12
    frozen = f"{_newton(last)}, lin as (select query, candidate, is_true, w0 + {' + '.join(f'w{i} * ({f} - mean_{f}) / scale_{f}' for i, f in enumerate(RANKED, 1))} as linear from cand, fit, b{last} where task = 'O')"
    named = " union all ".join(f"select '{f}' as feature, round(fill_{f}, 5) as fill, round(mean_{f}, 5) as mean, round(scale_{f}, 5) as scale, round(w{i}, 5) as coefficient from fit, b{last}" for i, f in enumerate(RANKED, 1))
    weights = "[" + ", ".join(f"{{'feature': '{f}', 'weight': w{i}, 'fill': {f'f{i}' if f == 'balance' else '0.0'}}}" for i, f in enumerate(FEATURES)) + "]"
    inside = f"p as (select channel, band, row_number() over (partition by channel, band order by frequency) as i, frequency, power from spectra join {_bands(S.BANDS | S.gamma_band(RATE))} on frequency between low and high)"
    area = f"{_WELCH}, {inside}, a as (select channel, band, sum((q.frequency - p.frequency) * (p.power + q.power) / 2) as power from p left join (select channel, band, i - 1 as i, frequency, power from p) q using (channel, band, i) group by all)"
    return {
        "welch_spectra": f"{_WELCH} select channel, round(frequency, 6) as frequency, round(power, 6) as power from spectra",
        "welch_band_powers": f"{area} select channel, band, round(power, 6) as power, round(log10(greatest(power, {S.LEAST_POWER})), 6) as log_power from a",
        "coherence_spectra": f'{_COHERENCE} select "left", "right", round(frequency, 6) as frequency, round(coherence, 6) as coherence from spectra',
        "band_coherences": f'{_COHERENCE} select "left", "right", band, round(avg(coherence), 6) as coherence from spectra join {_bands(S.COUPLING_BANDS)} on frequency between low and high group by all',
        "ridge_predictions": f"{_refitted()} select o_orderkey, subject, total, round(y_pred, 2) as y_pred, 'ok' as fold_status from pred",
        "ridge_weights": f"{_refitted()} select subject, n, e.feature as feature, round(e.weight, 4) as weight, round(e.fill, 4) as fill from (select fold as subject, n, unnest({weights}) as e from w join st using (fold))",
        "ridge_metrics": f"{_refitted()} select priority, count(*) as n, round(avg(abs(y_pred - total)), 3) as mae, round(sqrt(avg(pow(y_pred - total, 2))), 3) as rmse, round(corr(y_pred, total), 5) as pearson from pred group by priority",
        "factor_residuals": _freed(),
        "mahalanobis_scores": _mahalanobis(),
        "low_rank_scores": _eigen_scores("low_rank"),
        "subject_component_scores": _eigen_scores("components"),
        "ranker_coefficients": f"{_newton(last)} select 'intercept' as feature, null::double as fill, null::double as mean, null::double as scale, round(w0, 5) as coefficient from b{last} union all {named}",
        "ranker_scores": f"{frozen} select query, candidate, is_true, round(linear, 5) as linear, round(1 / (1 + exp(-greatest(least(linear, 50), -50))), 5) as probability from lin",
        "huber_slopes": _reweighted(),
        "subject_permutation_null": _dealt(),
        "montage_signals": f"with {_CHAIN} select x.recording, a, b, x.n, round(x.v - y.v, 4) as value from whole w join t x on x.recording = w.recording and x.c = a join t y on y.recording = w.recording and y.c = b and y.n = x.n where size >= 128 and x.n < size and (select count(*) from t m where m.recording = w.recording and m.n = x.n and m.c between least(a, b) and greatest(a, b)) = path_length + 1",
        "montage_provenance": f"with {_CHAIN} select recording, a, b, case when size >= 128 then 'bipolar_path_sum' else 'bipolar_path_too_short' end as mode, cast(path_length as int) as path_length, array_to_string([case when a < b then (a + i)::varchar || (a + i + 1)::varchar || ':+1' else (a - i - 1)::varchar || (a - i)::varchar || ':-1' end for i in range(path_length)], ';') as sources from whole",
        "event_windows": f"with {_CLIPPED} select recording, round(onset, 6) as onset, round(duration, 6) as duration, condition, source from w",
        "window_samples": f"with {_CLIPPED} select w.recording, w.onset, w.duration, w.condition, count(*) as n, round(sum(ev.duration), 4) as total from w join ev on ev.recording = w.recording and ev.onset >= w.onset and ev.onset < w.onset + w.duration group by all",
    }
