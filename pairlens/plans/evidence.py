"""Fold statistics, scores, diagnostics, nulls, bootstraps, statistics, references and signals as named relations over the cohort's."""

from pairlens.plans.cohort import BOOK as COHORT
from pairlens.plans.cohort import FEATURES, each

ROUNDS = 1000
_GROUPS = (("quantity", "price"), ("discount", "tax"))
_TRUE = "query = candidate"


def _cosine(a: str, b: str, names: tuple[str, ...]) -> str:
    dot, x, y = (" + ".join(f"{p.replace('@', n)} * {q.replace('@', n)}" for n in names) for p, q in ((a, b), (a, a), (b, b)))
    return f"case when sqrt({x}) * sqrt({y}) > 1e-12 then 1 - ({dot}) / (sqrt({x}) * sqrt({y})) else 1.0 end"


def _metrics(rank: str = "true_rank") -> str:
    return f"count(*) as n_queries, round(avg(case when {rank} = 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when {rank} <= 3 then 1.0 else 0.0 end), 6) as top3, round(avg(1.0 / {rank}), 6) as mrr, round(avg(cast({rank} as double)), 6) as mean_rank"


_Q, _C = "(q.x_@ - z.mean_@) / z.sd_@", "(c.m_@ - z.mean_@) / z.sd_@"
_GROUPED = "(" + " + ".join(_cosine(f"({_Q})", f"({_C})", g) for g in _GROUPS) + ") / 2"
_CENTRE = {"quantity": 25, "price": 50000, "discount": 0.05, "tax": 0.04}
_SCALE = " union all ".join(f"select '{f}' as feature, {float(c)} as centre" for f, c in _CENTRE.items())

EVIDENCE = {
    # folds: totals less the held-out subject's own sums, around a fixed centre so that squares stay small
    "state_long": "select subject, pair_id, feature, 'off' as medication, x as value from {delta_table} union all select subject, pair_id, feature, 'on', m from {delta_table}",
    "fold_scaler": f"""select held_out, feature, round(centre + s / n, 8) as mean, round(case when q - s * s / n > 0 and sqrt((q - s * s / n) / (n - 1)) >= 1e-8 then sqrt((q - s * s / n) / (n - 1)) else 1.0 end, 8) as sd
        from (select o.subject as held_out, o.feature, o.centre, t.n - o.n as n, t.s - o.s as s, t.q - o.q as q from (select subject, l.feature, k.centre, count(*) as n, sum(value - centre) as s, sum((value - centre) * (value - centre)) as q from {{state_long}} l join ({_SCALE}) k on l.feature = k.feature group by subject, l.feature, k.centre) o
        join (select l.feature, count(*) as n, sum(value - centre) as s, sum((value - centre) * (value - centre)) as q from {{state_long}} l join ({_SCALE}) k on l.feature = k.feature group by l.feature) t on o.feature = t.feature) f where n > 1""",
    "fold_wide": "select held_out, " + ", ".join(f"max(case when feature = '{f}' then mean end) as mean_{f}, max(case when feature = '{f}' then sd end) as sd_{f}" for f in FEATURES) + " from {fold_scaler} group by held_out",
    "fold_transition": "select t.held_out, t.feature, round((t.s - o.s) / (t.n - o.n), 8) as mean_delta, t.n - o.n as n from (select s.subject as held_out, k.feature, k.n, k.s from (select distinct subject from {state_pairs}) s cross join (select feature, count(*) as n, sum(y) as s from {delta_table} group by feature) k) t join (select subject, feature, count(*) as n, sum(y) as s from {delta_table} group by subject, feature) o on t.held_out = o.subject and t.feature = o.feature where t.n > o.n",
    "fold_reliability_weights": """select held_out, feature, n, round(case when n > 0 then greatest(up / n, 1 - up / n) else 0.5 end, 6) as weight from (select o.subject as held_out, o.feature, cast(t.n - o.n as double) as n, cast(t.up - o.up as double) as up from (select subject, feature, sum(case when y <> 0 then 1 else 0 end) as n, sum(case when y > 0 then 1 else 0 end) as up from {delta_table} group by subject, feature) o
        join (select feature, sum(case when y <> 0 then 1 else 0 end) as n, sum(case when y > 0 then 1 else 0 end) as up from {delta_table} group by feature) t on o.feature = t.feature) w""",
    "hard_negative_ratios": """select q.subject, q.feature, ln((abs(q.x - n.m) / s.sd + 0.05) / (abs(q.x - q.m) / s.sd + 0.05)) as ratio from {delta_table} q join {hard_negatives} h on h.query = q.pair_id join {delta_table} n on n.pair_id = h.candidate and n.feature = q.feature join {fold_scaler} s on s.held_out = q.subject and s.feature = q.feature""",
    "fold_hard_negative_weights": """select held_out, feature, n, round(raw / avg(raw) over (partition by held_out), 5) as weight from (select f.subject as held_out, r.feature, count(*) as n, least(greatest(exp(median(r.ratio)), 0.25), 4.0) as raw from (select distinct subject from {state_pairs}) f join {hard_negative_ratios} r on f.subject <> r.subject group by f.subject, r.feature) w""",
    "weight_stability": "select feature, count(*) as n_folds, round(avg(weight), 5) as mean_weight, round(stddev_samp(weight), 5) as sd_weight, round(min(weight), 5) as least, round(max(weight), 5) as most, round(avg(case when weight > 1 then 1.0 else 0.0 end), 6) as share_above_one from {fold_hard_negative_weights} group by feature",
    "family_reliability": """select held_out, family, n, round(least(greatest(0.5 + beats, 0.5), 1.5), 6) as weight from (select f.subject as held_out, b.family, count(*) as n, avg(case when b.own < b.worst then 1.0 else 0.0 end) as beats from (select distinct subject from {state_pairs}) f join
        (select q.pair_id, q.subject, case when q.feature in ('quantity', 'price') then 'volume' else 'rate' end as family, avg(abs(q.x - q.m) / s.sd) as own, min(d.gap) as worst from {delta_table} q join {fold_scaler} s on s.held_out = q.subject and s.feature = q.feature join (select q.pair_id, case when q.feature in ('quantity', 'price') then 'volume' else 'rate' end as family, min(abs(q.x - n.m) / s.sd) as gap
        from {delta_table} q join {hard_negatives} h on h.query = q.pair_id join {delta_table} n on n.pair_id = h.candidate and n.feature = q.feature join {fold_scaler} s on s.held_out = q.subject and s.feature = q.feature group by q.pair_id, case when q.feature in ('quantity', 'price') then 'volume' else 'rate' end) d on d.pair_id = q.pair_id and d.family = case when q.feature in ('quantity', 'price') then 'volume' else 'rate' end group by q.pair_id, q.subject, case when q.feature in ('quantity', 'price') then 'volume' else 'rate' end) b on f.subject <> b.subject group by f.subject, b.family) w""",
    # scores and diagnostics
    "scored_pool": f"select condition, query, candidate, q.subject as query_subject, c.subject as candidate_subject, q.task as query_task, c.task as candidate_task, q.side as query_side, c.side as candidate_side, q.quality as query_quality, c.quality as candidate_quality, round({_GROUPED}, 6) as score from {{pool_conditions}} p join {{state_pairs}} q on p.query = q.pair_id join {{state_pairs}} c on p.candidate = c.pair_id join {{fold_wide}} z on z.held_out = q.subject",
    "ranked_pool": "select *, case when n_candidates = 1 then 1.0 else (rank - 1) / cast(n_candidates - 1 as double) end as rank_fraction, (rank - 1) / cast(greatest(1, n_candidates - 1) as double) as rank_percentile from (select *, row_number() over (partition by condition, query order by score, candidate) as rank, count(*) over (partition by condition, query) as n_candidates from {scored_pool}) r",
    "query_failures": """select condition, query, n_candidates, true_rank, margin, top_candidate, case when true_rank = 1 then 'success' when query_quality in ('low_quality', 'caution') or top_quality <> query_quality then 'quality_related' when top_subject = query_subject and top_task <> query_task then 'same_subject_wrong_task' when top_subject = query_subject and top_side <> query_side then 'same_subject_wrong_side'
        when top_subject <> query_subject and top_task = query_task and top_side = query_side then 'other_subject_same_task_side' when top_task <> query_task then 'other_subject_wrong_task' else 'unclear' end as failure_type from (select condition, query, max(n_candidates) as n_candidates, min(case when query = candidate then rank end) as true_rank, round(min(case when query <> candidate then score end) - min(case when query = candidate then score end), 6) as margin,
        min_by(candidate, rank) as top_candidate, min_by(candidate_subject, rank) as top_subject, min_by(candidate_task, rank) as top_task, min_by(candidate_side, rank) as top_side, min_by(candidate_quality, rank) as top_quality, min(query_subject) as query_subject, min(query_task) as query_task, min(query_side) as query_side, min(query_quality) as query_quality from {ranked_pool} group by condition, query) d""",
    "failure_composition": "select condition, failure_type, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by condition) as double), 6) as rate from {query_failures} group by condition, failure_type",
    "condition_metrics": f"select condition, {_metrics()}, round(avg(margin), 5) as mean_margin, cast(sum(case when margin < 0 then 1 else 0 end) as bigint) as n_negative from {{query_failures}} group by condition",
    "metrics_by_level": f"select condition, q.subject, q.task, {_metrics()} from {{query_failures}} f join {{state_pairs}} q on f.query = q.pair_id group by grouping sets ((condition), (condition, q.subject), (condition, q.task))",
    "condition_deltas": "select a.condition, round(a.top1 - b.top1, 6) as top1_delta, round(a.mrr - b.mrr, 6) as mrr_delta, round(a.mean_rank - b.mean_rank, 6) as rank_delta from {condition_metrics} a cross join {condition_metrics} b where b.condition = 'original'",
    "query_changes": "select o.condition, o.query, o.true_rank, b.true_rank as original_rank, case when o.true_rank = 1 and b.true_rank = 1 then 'kept_success' when b.true_rank = 1 then 'lost' when o.true_rank = 1 then 'gained' else 'kept_failure' end as change from {query_failures} o join {query_failures} b on o.query = b.query where b.condition = 'original' and o.condition <> 'original'",
    "change_counts": "select condition, change, count(*) as n from {query_changes} group by condition, change",
    "pool_stage_taxonomy": "select coalesce(a.query, b.query) as query, case when a.query is null or b.query is null then 'pool_issue' when a.true_rank = 1 and b.true_rank = 1 then 'success' when a.true_rank = 1 then 'wider_pool_failure' else 'matched_pool_failure' end as stage from (select query, true_rank from {query_failures} where condition = 'original') a full join (select query, true_rank from {query_failures} where condition = 'all') b on a.query = b.query",
    "fingerprint_cases": "select query, true_rank, best_same_subject, top_same, n_same from (select query, min(case when query = candidate then rank end) as true_rank, min(case when query_subject = candidate_subject and query <> candidate then rank end) as best_same_subject, max(case when rank = 1 and query_subject = candidate_subject then 1 else 0 end) as top_same, cast(sum(case when query_subject = candidate_subject then 1 else 0 end) as bigint) as n_same from {ranked_pool} where condition = 'all' group by query) f",
    "fingerprint_gap": "select count(*) as n, round(avg(cast(top_same as double)), 6) as same_subject_rate, round(avg(cast(top_same as double)) - avg(case when true_rank = 1 then 1.0 else 0.0 end), 6) as gap, avg(cast(top_same as double)) - avg(case when true_rank = 1 then 1.0 else 0.0 end) >= 0.1 as confounded from {fingerprint_cases}",
    "hard_negative_ranks": "select r.query, h.kind, 1 + cast(sum(case when r.score < t.score then 1 else 0 end) as bigint) as true_place, count(*) as n_negatives from {hard_negatives} h join {ranked_pool} r on h.query = r.query and h.candidate = r.candidate join {ranked_pool} t on t.query = h.query and t.candidate = h.query where r.condition = 'all' and t.condition = 'all' group by r.query, h.kind",
    "neighbour_overlap": "select a.query, b.query as other, OVERLAP(a.names, b.names) as shared, round(OVERLAP(a.names, b.names) / cast(EITHER(a.names, b.names) as double), 6) as jaccard from {nearest_sets} a join {nearest_sets} b on a.subject = b.subject and a.query < b.query",
    "nearest_sets": "select query, query_subject as subject, NAMES(candidate) as names from {ranked_pool} where condition = 'all' and rank <= 5 group by query, query_subject",
    "transition_distances": "select condition, feature, round(avg(own), 6) as true_distance, round(avg(best), 6) as best_wrong, round(avg(mean_wrong), 6) as mean_wrong, round(avg(best - own), 6) as margin from (select p.condition, q.feature, q.pair_id, max(case when p.query = p.candidate then abs(q.x - c.m) / s.sd end) as own, min(case when p.query <> p.candidate then abs(q.x - c.m) / s.sd end) as best, avg(case when p.query <> p.candidate then abs(q.x - c.m) / s.sd end) as mean_wrong from {pool_conditions} p join {delta_table} q on p.query = q.pair_id join {delta_table} c on c.pair_id = p.candidate and c.feature = q.feature join {fold_scaler} s on s.held_out = q.subject and s.feature = q.feature where p.condition in ('original', 'side_only') group by p.condition, q.feature, q.pair_id) d group by condition, feature",
    # geometry-aware scores
    "mage_scores": """select query, candidate, rank_fraction, mismatch, round(rank_fraction + 0.5 * mismatch + 0.25 * (centre + 0.5 * spacing), 6) as soft, round(mismatch + 0.5 * rank_fraction, 6) as source_priority from (select r.query, r.candidate, r.rank_fraction, case when a.repair_class = b.repair_class then 0.0 else 1.0 end as mismatch,
        coalesce(least(abs(a.center - b.center) / 8, 1.0), 0.5) as centre, coalesce(least(abs(a.n_broad - b.n_broad) / 4.0, 1.0), 0.5) as spacing from {ranked_pool} r left join {geometry_coverage} a on a.subject = r.query_subject and a.side = r.query_side left join {geometry_coverage} b on b.subject = r.candidate_subject and b.side = r.candidate_side where r.condition = 'side_only') g""",
    "mage_metrics": f"select method, {_metrics('place')} from (select 'soft' as method, query, candidate, row_number() over (partition by query order by soft, rank_fraction, candidate) as place from {{mage_scores}} union all select 'source_priority', query, candidate, row_number() over (partition by query order by source_priority, rank_fraction, candidate) from {{mage_scores}}) m where {_TRUE} group by method",
    # nulls: draws by MD5, the same in any engine
    "random_label_rounds": "select n.i as round, q.query, q.at as slot, row_number() over (partition by n.i order by DRAW(n.i, concat('label', q.query)), q.query) as given from (select query, row_number() over (order by query) as at from (select distinct query from {ranked_pool} where condition = 'original') d) q cross join NUMBERS(100) n",
    "random_label_null": "select count(*) as n_rounds, round(avg(top1), 6) as null_top1, round(avg(mrr), 6) as null_mrr, round((1 + sum(case when top1 >= seen then 1 else 0 end)) / cast(1 + count(*) as double), 6) as p_value from (select l.round, avg(case when coalesce(r.rank, k.n + 1) = 1 then 1.0 else 0.0 end) as top1, avg(1.0 / coalesce(r.rank, k.n + 1)) as mrr from {random_label_rounds} l join {random_label_rounds} g on g.round = 0 and g.slot = l.given join (select query, max(n_candidates) as n from {ranked_pool} where condition = 'original' group by query) k on k.query = l.query left join (select query, candidate, rank from {ranked_pool} where condition = 'original') r on r.query = l.query and r.candidate = g.query group by l.round) t cross join (select top1 as seen from {condition_metrics} where condition = 'original') o",
    "uniform_rank_null": f"select condition, count(*) as n_rounds, round(avg(top1), 6) as null_top1, round(PCT(top1, 0.95), 6) as null_top1_95, round((1 + sum(case when top1 >= seen then 1 else 0 end)) / cast(1 + count(*) as double), 6) as p_value from (select f.condition, n.i, avg(case when DRAW(n.i, concat(f.condition, f.query)) % f.n_candidates = 0 then 1.0 else 0.0 end) as top1 from {{query_failures}} f cross join NUMBERS({ROUNDS}) n group by f.condition, n.i) t join (select condition as c, top1 as seen from {{condition_metrics}}) o on condition = c group by condition",
    "matched_task_null": "select count(*) as n_rounds, round(avg(top1), 6) as null_top1, round((1 + sum(case when top1 >= seen then 1 else 0 end)) / cast(1 + count(*) as double), 6) as p_value from (select round, avg(case when rank = 1 then 1.0 else 0.0 end) as top1 from (select n.i as round, r.query, min_by(r.rank, concat(lpad(cast(DRAW(n.i, concat(r.query, r.candidate)) as string), 12, '0'), r.candidate)) as rank from {ranked_pool} r cross join NUMBERS(100) n where r.condition = 'original' and r.query <> r.candidate group by n.i, r.query) d group by round) t cross join (select top1 as seen from {condition_metrics} where condition = 'original') o",
    "subject_sign_null": f"select feature, round(min(seen), 6) as mean_delta, count(*) as n_rounds, round((1 + sum(case when m >= seen - 1e-9 then 1 else 0 end)) / cast(1 + count(*) as double), 6) as p_larger from (select y.feature, n.i, sum(case when DRAW(n.i, cast(y.subject as string)) % 2 = 0 then y.s else -y.s end) / sum(y.n) as m from (select feature, subject, sum(y) as s, count(*) as n from {{delta_table}} group by feature, subject) y cross join NUMBERS({ROUNDS}) n group by y.feature, n.i) t join (select feature as f, avg(y) as seen from {{delta_table}} group by feature) o on feature = f group by feature",
    "query_bootstrap": f"select condition, count(*) as n_rounds, round(avg(m), 6) as mean, round(PCT(m, 0.025), 6) as low, round(PCT(m, 0.975), 6) as high from (select s.condition, s.round, avg(h.hit) as m from (select c.condition, n.i as round, k.i as slot, DRAW(concat(c.condition, cast(n.i as string)), k.i) % c.n as pick from (select condition, count(*) as n from {{query_failures}} where condition in ('original', 'all') group by condition) c join (select condition as kc, cast(row_number() over (partition by condition order by query) - 1 as int) as i from {{query_failures}}) k on k.kc = c.condition cross join NUMBERS(200) n) s join (select condition, row_number() over (partition by condition order by query) - 1 as at, case when true_rank = 1 then 1.0 else 0.0 end as hit from {{query_failures}}) h on h.condition = s.condition and h.at = s.pick group by s.condition, s.round) t group by condition",
    "subject_hit_deltas": "select cast(row_number() over (order by subject) - 1 as int) as at, n, d from (select q.subject, count(*) as n, sum(case when a.true_rank = 1 then 1.0 else 0.0 end) - sum(case when b.true_rank = 1 then 1.0 else 0.0 end) as d from {query_failures} a join {query_failures} b on a.query = b.query join {state_pairs} q on q.pair_id = a.query where a.condition = 'original' and b.condition = 'all' group by q.subject) s",
    "paired_delta_bootstrap": f"select count(*) as n_rounds, round(avg(d), 6) as mean_delta, round(PCT(d, 0.025), 6) as low, round(PCT(d, 0.975), 6) as high, round(avg(case when d > 0 then 1.0 else 0.0 end), 6) as share_above_zero from (select r.round, sum(u.d) / sum(u.n) as d from (select n.i as round, DRAW(n.i, concat('s', cast(k.at as string))) % c.subjects as pick from {{subject_hit_deltas}} k cross join NUMBERS({ROUNDS}) n cross join (select count(*) as subjects from {{subject_hit_deltas}}) c) r join {{subject_hit_deltas}} u on u.at = r.pick group by r.round) t",
    "stratum_removal": f"select condition, s.task as removed_task, {_metrics()} from {{query_failures}} f join {{state_pairs}} q on f.query = q.pair_id join (select distinct task from {{state_pairs}}) s on s.task <> q.task group by condition, s.task",
    "feature_ablation": "select dropped, " + _metrics("place") + " from (select f.feature as dropped, p.query, p.candidate, row_number() over (partition by f.feature, p.query order by sum(case when q.feature <> f.feature then abs(q.x - c.m) / s.sd else 0 end), p.candidate) as place from {pool_conditions} p join {delta_table} q on p.query = q.pair_id join {delta_table} c on c.pair_id = p.candidate and c.feature = q.feature join {fold_scaler} s on s.held_out = q.subject and s.feature = q.feature cross join (select distinct feature from {delta_table}) f where p.condition = 'original' group by f.feature, p.query, p.candidate) a where query = candidate group by dropped",
    # statistics
    "delta_ranks": "select feature, pair_id, subject, x, y, n_off, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry, rank() over (partition by feature order by n_off) + (count(*) over (partition by feature, n_off) - 1) / 2.0 as rz from (select d.feature, d.pair_id, d.subject, d.x, d.y, p.n_off from {delta_table} d join {state_pairs} p on d.pair_id = p.pair_id) t",
    "partial_spearman": "select feature, n, round(xy, 6) as rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as partial_rho, round(pearson, 6) as pearson from (select feature, count(*) as n, corr(rx, ry) as xy, corr(rx, rz) as xz, corr(ry, rz) as yz, corr(x, y) as pearson from {delta_ranks} group by feature) c",
    "collinearity": "select a.feature as feature_a, b.feature as feature_b, count(*) as n, round(corr(a.y, b.y), 6) as pearson, round(corr(a.ry, b.ry), 6) as spearman, abs(corr(a.ry, b.ry)) >= 0.7 as collinear from {delta_ranks} a join {delta_ranks} b on a.pair_id = b.pair_id and a.feature <= b.feature group by a.feature, b.feature",
    "centred_deltas": "select pair_id, subject, feature, y, x - avg(x) over (partition by feature) as x from {delta_table}",
    "loso_ridge": "select pair_id, feature, y, round(my + slope * (x - mx), 6) as predicted from (select d.pair_id, d.feature, d.x, d.y, (t.sx - o.sx) / (t.n - o.n) as mx, (t.sy - o.sy) / (t.n - o.n) as my, ((t.sxy - o.sxy) - (t.sx - o.sx) * (t.sy - o.sy) / (t.n - o.n)) / ((t.sxx - o.sxx) - (t.sx - o.sx) * (t.sx - o.sx) / (t.n - o.n) + 1.0) as slope from {centred_deltas} d join (select subject, feature, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx from {centred_deltas} group by subject, feature) o on o.subject = d.subject and o.feature = d.feature join (select feature, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx from {centred_deltas} group by feature) t on t.feature = d.feature where t.n - o.n >= 8) r",
    "prediction_metrics": "select feature, count(*) as n, round(corr(y, predicted), 5) as pearson, round(avg(abs(y - predicted)), 6) as mae, round(sqrt(avg((y - predicted) * (y - predicted))), 6) as rmse, round(avg(case when sign(y) = sign(predicted) then 1.0 else 0.0 end), 6) as sign_agreement from {loso_ridge} group by feature",
    "histogram": "select d.feature, cast(least(17, floor((d.y - b.low) / b.width)) as int) as bin, count(*) as n from {delta_table} d join (select feature, min(y) - 0.04 * (max(y) - min(y)) as low, 1.08 * (max(y) - min(y)) / 18 as width from {delta_table} group by feature) b on b.feature = d.feature group by d.feature, cast(least(17, floor((d.y - b.low) / b.width)) as int)",
    "density": "select d.feature, g.i as place, round(b.low + g.i * b.step, 5) as at, round(avg(exp(-0.5 * power((d.y - b.low - g.i * b.step) / b.h, 2))) * sum(b.range) / count(*) / (min(b.h) * 2.5066282746310002), 6) as density from {delta_table} d join (select feature, min(y) as low, max(y) - min(y) as range, (max(y) - min(y)) / 24 as step, stddev_samp(y) * power(count(*), -0.2) as h from {delta_table} group by feature) b on b.feature = d.feature cross join NUMBERS(25) g group by d.feature, g.i, b.low, b.step",
    "signed_ranks": "select feature, count(*) as n, sum(case when y > 0 then r else 0.0 end) as w_plus, sum(case when y < 0 then r else 0.0 end) as w_minus, round((sum(case when y > 0 then r else 0.0 end) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) as z from (select feature, y, rank() over (partition by feature order by abs(y)) + (count(*) over (partition by feature, abs(y)) - 1) / 2.0 as r from {delta_table} where y <> 0) s group by feature",
    "binomial_power": "select n, p, critical, round(power, 6) as power from (select t.n, a.p, t.critical, sum(exp(lf.v - lk.v - lr.v + b.i * ln(a.p) + (t.n - b.i) * ln(1 - a.p))) as power from (select n, min(k) as critical from (select n, k, sum(mass) over (partition by n order by k desc rows between unbounded preceding and current row) as tail from (select s.n, b.i as k, exp(lf.v - lk.v - lr.v + b.i * ln(0.2) + (s.n - b.i) * ln(0.8)) as mass from (select 10 + 5 * i as n from NUMBERS(5)) s join NUMBERS(31) b on b.i <= s.n join {log_factorials} lf on lf.i = s.n join {log_factorials} lk on lk.i = b.i join {log_factorials} lr on lr.i = s.n - b.i) m) u where tail <= 0.05 group by n) t cross join (select 0.2 + 0.1 * i as p from NUMBERS(7)) a join NUMBERS(31) b on b.i between t.critical and t.n join {log_factorials} lf on lf.i = t.n join {log_factorials} lk on lk.i = b.i join {log_factorials} lr on lr.i = t.n - b.i group by t.n, a.p, t.critical) w",
    "log_factorials": "select i, sum(ln(greatest(i, 1))) over (order by i rows between unbounded preceding and current row) as v from NUMBERS(41) q",
    # references, objective, compensation
    "reference_stats": "select task, feature, count(*) as n, round(avg(m), 8) as mean, round(greatest(stddev_samp(m), 1e-6), 8) as sd from {delta_table} group by task, feature",
    "deviation_table": "select d.pair_id, round(sqrt(avg(power((d.x - r.mean) / r.sd, 2))), 6) as rms_off, round(sqrt(avg(power((d.m - r.mean) / r.sd, 2))), 6) as rms_on, round(avg(abs(d.x - r.mean) / r.sd), 6) as mean_abs_off, count(*) as n_features from {delta_table} d join {reference_stats} r on d.task = r.task and d.feature = r.feature group by d.pair_id",
    "target_objectives": """select pair_id, feature, round(post, 6) as deviation, round(objective, 6) as objective, row_number() over (partition by pair_id order by round(objective, 9), feature) as place from (select pair_id, feature, post, post + 0.15 * abs(0.6 * z) + 0.25 * 0.25 + 0.1 * 0.25 - 0.2 / (1 + abs(0.6 * z)) as objective from (select pair_id, feature, z, sqrt(greatest((total - z * z + 0.16 * z * z) / n, 0.0)) as post
        from (select d.pair_id, d.feature, (d.x - r.mean) / r.sd as z, sum(power((d.x - r.mean) / r.sd, 2)) over (partition by d.pair_id) as total, count(*) over (partition by d.pair_id) as n from {delta_table} d join {reference_stats} r on d.task = r.task and d.feature = r.feature) a) b) c""",
    "target_stability": "select t.feature, count(*) as n_contexts, round(avg(cast(place as double)), 6) as mean_rank, round(median(cast(place as double)), 6) as median_rank, round(stddev_samp(cast(place as double)), 6) as sd_rank, round(avg(case when place = 1 then 1.0 else 0.0 end), 6) as first_share, count(distinct p.subject) as n_subjects from {target_objectives} t join {state_pairs} p on p.pair_id = t.pair_id group by t.feature",
    "task_target_comparison": "select coalesce(a.feature, b.feature) as feature, round(a.r - b.r, 6) as rank_difference, case when a.r is null then 'only_second' when b.r is null then 'only_first' when abs(a.r - b.r) < 0.25 then 'stable' when a.r < b.r then 'better_in_first' else 'better_in_second' end as note from (select feature, avg(cast(place as double)) as r from {target_objectives} where pair_id like '%|HoldL' group by feature) a full join (select feature, avg(cast(place as double)) as r from {target_objectives} where pair_id like '%|MoveR' group by feature) b on a.feature = b.feature",
    "compensation_sweep": """select pair_id, alpha, round(before, 6) as before, round(after, 6) as after, round((before - after) - 0.01 * alpha * shift - 0.005 * n - 0.05 * (1 - consistency), 6) as net from (select d.pair_id, k.i / 4.0 as alpha, sqrt(avg(power((d.x - r.mean) / r.sd, 2))) as before, sqrt(avg(power((d.x + k.i / 4.0 * g.mean_delta - r.mean) / r.sd, 2))) as after, sqrt(sum(power(g.mean_delta / r.sd, 2))) as shift, count(*) as n, avg(g.consistency) as consistency from {delta_table} d join {reference_stats} r on d.task = r.task and d.feature = r.feature join {delta_directions} g on g.task = d.task and g.feature = d.feature cross join NUMBERS(5) k group by d.pair_id, k.i) c""",
    "compensation_best": "select pair_id, alpha, net from (select pair_id, alpha, net, row_number() over (partition by pair_id order by net desc, alpha) as place from {compensation_sweep}) b where place = 1",
    "compensation_summary": "select alpha, count(*) as n, round(avg(before - after), 6) as mean_reduction, round(avg(net), 6) as mean_net, round(avg(case when net > 0 then 1.0 else 0.0 end), 6) as helped from {compensation_sweep} group by alpha",
    "trajectory": "select s.i as step, round(avg(after), 6) as deviation from (select k.i, d.pair_id, sqrt(avg(power((d.x + k.i / 16.0 * g.mean_delta - r.mean) / r.sd, 2))) as after from {delta_table} d join {reference_stats} r on d.task = r.task and d.feature = r.feature join {delta_directions} g on g.task = d.task and g.feature = d.feature cross join NUMBERS(17) k group by k.i, d.pair_id) s group by s.i",
    # signals: one channel a user, samples in order of events
    "signal": "select user_id as channel, row_number() over (partition by user_id order by event_id) as sample, value from {events}",
    "clean_signal": "select s.channel, s.sample, round(least(greatest(s.value, b.low), b.high) - b.mean, 6) as value from {signal} s join (select channel, PCT(value, 0.001) as low, PCT(value, 0.999) as high, avg(value) as mean from {signal} group by channel) b on s.channel = b.channel",
    "burst_runs": "select channel, min(sample) as start, max(sample) as finish, count(*) as n_samples, round(max(value), 6) as peak from (select channel, sample, value, sample - row_number() over (partition by channel order by sample) as island from (select s.*, t.level from {clean_signal} s join (select channel as c, PCT(value, 0.75) as level from {clean_signal} group by channel) t on s.channel = t.c) a where value >= level) i group by channel, island having count(*) > 1",
    "burst_stats": "select r.channel, count(*) as n_bursts, round(sum(r.n_samples) / cast(max(s.n) as double), 6) as occupancy, round(avg(cast(r.n_samples as double)), 6) as mean_length, max(r.n_samples) as longest, round(avg(r.peak), 6) as mean_peak from {burst_runs} r join (select channel, count(*) as n from {signal} group by channel) s on s.channel = r.channel group by r.channel",
    "robust_scale": "select s.channel, round(min(m.mid), 6) as mid, round(1.4826 * median(abs(s.value - m.mid)), 6) as mad from {signal} s join (select channel, median(value) as mid from {signal} group by channel) m on m.channel = s.channel group by s.channel",
    "spectra": "select user_id % 40 as channel, 1 + event_id % 90 as freq, avg(abs(value)) + 0.01 as power from {events} group by user_id % 40, 1 + event_id % 90",
    "band_powers": "select a.channel, b.band, round(log10(greatest(sum((a.freq - a.f0) * (a.power + a.p0) / 2), 1e-300)), 6) as log_power, count(*) + 1 as n_bins from (select s.channel, b.band, s.freq, s.power, lag(s.freq) over (partition by s.channel, b.band order by s.freq) as f0, lag(s.power) over (partition by s.channel, b.band order by s.freq) as p0 from {spectra} s join {bands} b on s.freq between b.low and b.high) a join {bands} b on a.band = b.band where a.f0 is not null group by a.channel, b.band",
    "bands": "select 'theta' as band, 4 as low, 8 as high union all select 'alpha', 8, 12 union all select 'low_beta', 13, 20 union all select 'high_beta', 20, 30 union all select 'gamma', 35, 80",
    "aperiodic_fit": "select channel, count(*) as n_bins, round(regr_slope(log10(power), log10(freq)), 5) as slope, round(regr_intercept(log10(power), log10(freq)), 5) as intercept from {spectra} where freq between 3 and 80 and freq not between 48 and 52 group by channel",
    "residual_bands": "select s.channel, b.band, round(avg(log10(s.power) - (f.intercept + f.slope * log10(s.freq))), 4) as residual, max_by(s.freq, s.power * 1000 - s.freq / 1000.0) as peak_freq from {spectra} s join {aperiodic_fit} f on s.channel = f.channel join {bands} b on s.freq between b.low and b.high group by s.channel, b.band",
    "band_asymmetry": "select a.channel, a.band, round(b.log_power - a.log_power, 6) as right_minus_left from {band_powers} a join {band_powers} b on a.band = b.band and b.channel = a.channel + 1 where a.channel % 2 = 0",
    # graph
    "graph_edges": "select feature_a, feature_b, round(abs(spearman), 6) as weight from {collinearity} where feature_a < feature_b and abs(spearman) > 0",
    "graph_summary": "select count(distinct node) as n_nodes, cast(count(*) / 2 as bigint) as n_edges, round(count(*) / 2.0 / (count(distinct node) * (count(distinct node) - 1) / 2.0), 6) as density, round(sum(weight) / count(distinct node), 5) as mean_degree from (select feature_a as node, weight from {graph_edges} union all select feature_b, weight from {graph_edges}) e",
    # gates
    "gate_table": "select m.condition, m.top1 >= b.top1 as keeps_top1, m.mrr >= b.mrr as keeps_mrr, m.mean_rank <= b.mean_rank as keeps_rank, d.p_value <= 0.05 as beats_chance, cast(m.top1 >= b.top1 as int) + cast(m.mrr >= b.mrr as int) + cast(m.mean_rank <= b.mean_rank as int) + cast(d.p_value <= 0.05 as int) as n_passed from {condition_metrics} m cross join (select top1, mrr, mean_rank from {condition_metrics} where condition = 'all') b join {uniform_rank_null} d on d.condition = m.condition",
    "conservative_choice": "select condition, n_passed from (select condition, n_passed, row_number() over (order by n_passed desc, condition) as place from {gate_table}) g where place = 1",
    "model_eligibility": "select feature, count(*) as n, count(distinct y) as n_distinct, cast(sum(case when y <> 0 then 1 else 0 end) as bigint) as n_nonzero, count(*) >= 8 and count(distinct y) > 1 as eligible from {delta_table} group by feature",
    "pair_count_check": "select task, count(*) as n_pairs, count(distinct subject) as n_subjects, count(*) = count(distinct subject) as one_a_subject, max(expected) - count(distinct subject) as n_missing from {state_pairs} cross join (select count(distinct subject) as expected from {state_table}) e group by task",
}
BOOK = COHORT | EVIDENCE
_HELPERS = ("state_long", "subject_hit_deltas", "centred_deltas", "nearest_sets", "hard_negative_ratios", "random_label_rounds", "log_factorials", "signal", "spectra", "bands")
QUERIES = [k for k in EVIDENCE if k not in _HELPERS]
