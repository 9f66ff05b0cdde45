"""Labels, manifests, state vectors, pairs and candidate pools as named relations."""

FEATURES = ("quantity", "price", "discount", "tax")


def each(text: str, sep: str = ", ") -> str:
    """``text`` once for each feature, with @ as its name."""
    return sep.join(text.replace("@", f) for f in FEATURES)


_PATH = """concat('sub-', cast(user_id % 20 as string), '/ses-', case when event_id % 3 = 0 then 'PeriOp' else 'Lab' end, '/meg/sub-', cast(user_id % 20 as string), '_task-',
    case event_id % 7 when 0 then 'HoldL' when 1 then 'HoldR' when 2 then 'MoveL' when 3 then 'MoveR' when 4 then 'Rest' when 5 then 'Tap' else 'restingState' end,
    case event_id % 4 when 0 then '_acq-MedOff' when 1 then '_acq-MedOn' when 2 then '_med-with_med' else '' end, '_run-', case when event_id % 11 = 0 then 'x' else cast(event_id % 3 as string) end,
    case when event_id % 2 = 0 then '_split-01' else '_split-02' end, case when event_id % 13 = 0 then '_off' else '' end, '_meg.fif')"""


def _medication(text: str) -> str:
    t = f"lower(trim({text}))"
    return f"""case when {t} in ('off', 'medoff', 'dopamineoff', 'withoutmed', 'without_med') then 'off' when {t} in ('on', 'medon', 'dopamineon', 'withmed', 'with_med') then 'on'
        when {t} like '%off%' and {t} not like '%on%' then 'off' when {t} like '%on%' and {t} not like '%off%' then 'on' else 'unknown' end"""


def _word(w: str) -> str:
    return f"HAS(lower(path), '(med-?{w}|medication-?{w}|(^|[^a-z0-9_]){w}([^a-z0-9_]|$)|ses-?{w})')"


_CASES = """select n.i as case_id, case n.i % 8 when 0 then 'STN-L-01' when 1 then 'STN-R-12' when 2 then 'lfp_left_3' when 3 then 'LFP-right-0' when 4 then 'STN-L-2s3' when 5 then 'STN-R-03' when 6 then 'EEG' else 'STN-L-123' end as channel,
    n.i % 25 as subject, case when n.i % 2 = 0 then 'L' else 'R' end as side from NUMBERS(200) n"""

BOOK = {
    # paths and labels
    "recordings": f"select event_id as recording, user_id % 20 as subject_number, {_PATH} as path, value from {{events}}",
    "bids_entities": f"""select recording, path, subject, session, task, run, split, acquisition, case when given <> '' and given <> 'unknown' then given when {_word("off")} then 'off' when {_word("on")} then 'on' else 'unknown' end as medication,
        case when concat(lower(path), ' ', lower(task)) like '%rest%' then 'rest' when lower(path) like '%hold%' then 'hold' when lower(path) like '%move%' then 'move' when task = '' then 'unknown' else task end as condition
        from (select *, case when med <> '' then {_medication("med")} else {_medication("acquisition")} end as given from (select recording, path, regexp_extract(path, '(sub-[^_/]*)', 1) as subject, regexp_extract(path, '(ses-[^_/]*)', 1) as session,
        regexp_extract(path, 'task-([^_/]*)', 1) as task, regexp_extract(path, 'run-([^_/]*)', 1) as run, regexp_extract(path, 'split-([^_/]*)', 1) as split, regexp_extract(path, 'acq-([^_/]*)', 1) as acquisition,
        regexp_extract(path, 'med-([^_/]*)', 1) as med from {{recordings}}) a) b""",
    "task_labels": """select recording, task, case when right(task, 1) = 'L' then 'L' when right(task, 1) = 'R' then 'R' when lower(task) like 'rest%' then 'none' else 'unknown' end as side,
        case when lower(task) like 'hold%' then 'Hold' when lower(task) like 'move%' then 'Move' when lower(task) like 'rest%' then 'Rest' when task = '' then 'unknown' else task end as family,
        case when lower(task) in ('rest', 'resting', 'restingstate', 'resting_state') then 'none' when length(task) > 1 and upper(right(task, 1)) in ('L', 'R') then upper(right(task, 1)) when lower(task) like 'hold%' or lower(task) like 'move%' then 'unknown' else 'none' end as parsed_side,
        case when right(task, 1) = 'L' then 'right' when right(task, 1) = 'R' then 'left' else 'unknown' end as opposite_side, coalesce(try_cast(run as int), 9999) as run_order, condition, medication from {bids_entities}""",
    "logical_manifest": """select subject, session, task, acquisition, medication, run, count(*) as n_files, min_by(path, concat(split, path)) as canonical_path, DISTINCT_JOINED(split) as splits, cast(sum(case when split = '01' then 1 else 0 end) as bigint) as n_first
        from {bids_entities} group by subject, session, task, acquisition, medication, run""",
    "manifest_summary": "select count(distinct subject) as n_subjects, count(distinct concat(subject, '|', task)) as n_groups, count(*) as n_recordings, cast(sum(n_files) as bigint) as n_files, count(distinct task) as n_tasks from {logical_manifest}",
    "pair_inventory": """select subject, task, cast(sum(case when medication = 'off' then 1 else 0 end) as bigint) as n_off, cast(sum(case when medication = 'on' then 1 else 0 end) as bigint) as n_on,
        case when max(case when medication = 'off' then 1 else 0 end) = 1 and max(case when medication = 'on' then 1 else 0 end) = 1 then 'usable' when max(case when medication in ('off', 'on') then 1 else 0 end) = 1 then 'incomplete' else 'excluded' end as status from {logical_manifest} group by subject, task""",
    "canonical_pairs": """select subject, task, off_path, on_path from (select o.subject, o.task, o.canonical_path as off_path, n.canonical_path as on_path, row_number() over (partition by o.subject, o.task order by
        case when o.session = n.session then 0 else 1 end, case when o.run = n.run then 0 else 1 end, coalesce(try_cast(o.run as int), 9999), coalesce(try_cast(n.run as int), 9999), o.canonical_path, n.canonical_path) as place
        from {logical_manifest} o join {logical_manifest} n on o.subject = n.subject and o.task = n.task where o.medication = 'off' and n.medication = 'on') k where place = 1""",
    "inventory_gaps": """select a.subject, a.task, a.session, a.run, a.medication as only_state from {logical_manifest} a left join {logical_manifest} b on a.subject = b.subject and a.task = b.task and a.session = b.session and a.run = b.run
        and b.medication in ('off', 'on') and a.medication <> b.medication where a.medication in ('off', 'on') and b.subject is null""",
    # channels and geometry
    "channels": _CASES,
    "channel_geometry": """select case_id, channel, subject, side, lfp_side, lfp_index, exact_token, numeric_token, n_digits, pair_key, span, center, case when n_digits = 0 then 'unknown' when segment then 'segment' when n_digits = 2 and span = 1 then 'narrow' when n_digits = 2 then 'broad' else 'unknown' end as spacing_class,
        case when n_digits = 0 then 'unknown' when segment then 'segment_or_directional' when n_digits = 1 then 'single_or_monopolar_label' else 'valid_bipolar' end as geometry_class from (select *, cast(LAST_OF(digits) as int) - cast(FIRST_OF(digits) as int) as wide, case when n_digits > 1 then cast(LAST_OF(digits) as int) - cast(FIRST_OF(digits) as int) end as span,
        HAS(exact_token, '[0-9][sv]') or n_digits > 2 as segment, case when n_digits > 1 then TEXT(digits) else '' end as pair_key, case when n_digits > 0 then (cast(FIRST_OF(digits) as int) + cast(LAST_OF(digits) as int)) / 2.0 end as center
        from (select *, DIGITS(exact_token) as digits, COUNT_OF(DIGITS(exact_token)) as n_digits, SWAP(exact_token, '[^0-9]', '') as numeric_token from (select *, lower(SWAP(channel, '^(STN-[LR]-|LFP-|lfp_)', '')) as exact_token,
        lower(regexp_extract(lower(channel), 'lfp[-_](left|right)[-_]', 1)) as lfp_side, try_cast(nullif(regexp_extract(lower(channel), 'lfp[-_](?:left|right)[-_]([0-9]+)', 1), '') as int) as lfp_index from {channels}) a) b) c""",
    "geometry_coverage": """select subject, side, count(*) as n_channels, count(distinct exact_token) as n_tokens, cast(sum(case when spacing_class = 'narrow' then 1 else 0 end) as bigint) as n_narrow, cast(sum(case when spacing_class = 'broad' then 1 else 0 end) as bigint) as n_broad,
        case when max(case when spacing_class = 'narrow' then 1 else 0 end) = 1 then 'exact_narrow' when max(case when spacing_class = 'broad' then 1 else 0 end) = 1 then 'exact_broad' when max(case when spacing_class = 'segment' then 1 else 0 end) = 1 then 'segment_only' when max(n_digits) > 0 then 'numeric_only' else 'no_contact' end as repair_class,
        round(avg(center), 6) as center, DISTINCT_JOINED(exact_token) as tokens from {channel_geometry} group by subject, side""",
    "geometry_rates": "select repair_class, count(*) as n_cases, round(count(*) / cast(sum(count(*)) over () as double), 6) as rate from {geometry_coverage} group by repair_class",
    "pseudo_contacts": "select g.subject, g.side, d.i as contact, count(*) as n_channels, round(median(g.center), 6) as center from {channel_geometry} g join NUMBERS(10) d on g.numeric_token like concat('%', cast(d.i as string), '%') group by g.subject, g.side, d.i",
    # feature names
    "feature_names": """select concat(case n.i % 5 when 0 then 'm1' when 1 then 'sma' when 2 then 'stn' when 3 then 'left_m1' else 'right_m1' end, case when n.i % 2 = 0 then '_stn' else '' end, '_',
        case n.i % 6 when 0 then 'theta' when 1 then 'alpha' when 2 then 'low_beta' when 3 then 'high_beta' when 4 then 'gamma' else 'low_gamma' end, case when n.i % 2 = 0 then '_coupling' when n.i % 3 = 0 then '_asymmetry' else '_power' end) as feature, n.i as id from NUMBERS(60) n""",
    "feature_targets": """select id, feature, case when HAS(feature, '_stn_.*_coupling$') then 'edge_coupling_modulation' when HAS(feature, '^[^_]+_.+_power$') then 'node_band_modulation' else 'abstract_target' end as target_type, split_part(feature, '_', 1) as node,
        case when HAS(feature, '_stn_.*_coupling$') then concat(SWAP(feature, '_stn_.*$', ''), '-STN') else '' end as edge, feature like '%beta%' as is_beta, feature like '%stn%' as is_stn, feature like '%gamma%' as is_gamma, HAS(feature, '_coupling$') as is_coupling, HAS(feature, '_asymmetry$') as is_asymmetry,
        (feature like '%m1%' or feature like '%sma%') and (feature like '%beta%' or feature like '%gamma%') as is_cortical, case when HAS(feature, '_coupling$') then 'coupling' when HAS(feature, '_asymmetry$') then 'asymmetry' when feature like '%beta%' then 'beta_power' when feature like '%gamma%' then 'gamma_power' else 'other_power' end as family,
        SWAP(SWAP(feature, '^y_', ''), '(left|right)', 'hemi') as canonical_name from {feature_names}""",
    "feature_family_counts": "select family, target_type, count(*) as n_features, cast(sum(case when is_beta then 1 else 0 end) as bigint) as n_beta, cast(sum(case when is_stn then 1 else 0 end) as bigint) as n_stn, cast(sum(case when is_gamma then 1 else 0 end) as bigint) as n_gamma from {feature_targets} group by family, target_type",
    "target_penalties": """select id, feature, round(0.25 + case when node in ('STN', 'M1') then 0.35 else 0 end + case when edge <> '' then 0.1 else 0 end, 6) as risk, case when edge <> '' then 0.45 else 0.25 end as complexity, round(1 / (1 + id / 10.0), 6) as stability,
        round(0.02 + 0.05 * (id / 10.0) + 0.1 * (0.25 + case when edge <> '' then 0.1 else 0 end), 6) as uncertainty from {feature_targets}""",
    # states and pairs
    "windows": """select c_nationkey as subject, case substr(o_orderpriority, 1, 1) when '1' then 'HoldL' when '2' then 'HoldR' when '3' then 'MoveL' when '4' then 'MoveR' else 'Rest' end as task, case l_returnflag when 'A' then 'off' else 'on' end as medication,
        l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, l_orderkey as recording, l_linenumber as window_index from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey where l_returnflag in ('A', 'R')""",
    "state_table": f"select subject, task, medication, count(*) as n_windows, count(distinct recording) as n_recordings, {each('round(avg(@), 8) as @')} from {{windows}} group by subject, task, medication",
    "subject_states": f"select subject, medication, count(*) as n, {each('round(avg(@), 6) as @')} from {{state_table}} group by subject, medication",
    "condition_states": f"select task, medication, count(*) as n, {each('round(avg(@), 6) as @')} from {{state_table}} group by task, medication",
    "state_pairs": f"""select *, case when n_off % 5 = 0 then 'low_quality' when n_off % 3 = 0 then 'caution' else 'good' end as quality, case when task = 'Rest' then 'none' else right(task, 1) end as side, case when task = 'Rest' then 'Rest' else substr(task, 1, 4) end as family, concat(cast(subject as string), '|', task) as pair_id
        from (select subject, task, cast(sum(case when medication = 'off' then n_windows end) as bigint) as n_off, cast(sum(case when medication = 'on' then n_windows end) as bigint) as n_on, {each("max(case when medication = 'off' then @ end) as x_@")}, {each("max(case when medication = 'on' then @ end) as m_@")}
        from {{state_table}} group by subject, task) p where n_off is not null and n_on is not null""",
    "pair_quality": "select quality, count(*) as n_pairs, round(count(*) / cast(sum(count(*)) over () as double), 6) as share, cast(min(n_off) as bigint) as least_windows from {state_pairs} group by quality",
    "delta_table": " union all ".join(f"select pair_id, subject, task, side, family, quality, '{f}' as feature, x_{f} as x, m_{f} as m, round(m_{f} - x_{f}, 8) as y from {{state_pairs}}" for f in FEATURES),
    "feature_availability": "select feature, count(*) as n_pairs, round(avg(case when y is null then 0.0 else 1.0 end), 6) as finite_share, min(case when y is null then 0 else 1 end) = 1 as usable from {delta_table} group by feature",
    "delta_directions": """select feature, task, count(*) as n, round(avg(y), 6) as mean_delta, round(median(y), 6) as median_delta, round(stddev_samp(y), 6) as sd_delta, cast(sum(case when y > 1e-9 then 1 else 0 end) as bigint) as n_up, cast(sum(case when y < -1e-9 then 1 else 0 end) as bigint) as n_down,
        case when avg(y) > 1e-9 then 'increase' when avg(y) < -1e-9 then 'decrease' else 'no_change' end as direction, round(greatest(sum(case when y > 0 then 1 else 0 end), sum(case when y < 0 then 1 else 0 end)) / cast(count(*) as double), 6) as consistency from {delta_table} group by feature, task""",
    "oriented_components": """select pair_id, round(avg(case d.direction when 'decrease' then -y when 'increase' then y else abs(y) end), 6) as oriented_mean, round(avg(y), 6) as signed_mean, round(sqrt(sum(y * y)), 5) as norm, count(*) as n_features
        from {delta_table} t join (select feature as f, direction from {delta_directions} where task = 'Rest') d on t.feature = d.f group by pair_id""",
    # pools
    "pool_tiers": """select q.pair_id as query, c.pair_id as candidate, q.subject = c.subject as same_subject, q.task = c.task as same_task, q.family = c.family as same_family, q.side = c.side as same_side, q.quality = c.quality as same_quality, q.quality as query_quality, c.quality as candidate_quality,
        q.task as query_task, c.task as candidate_task, q.subject as query_subject, c.subject as candidate_subject from {state_pairs} q join {state_pairs} c on q.side = c.side""",
    "matched_pool": """select query, candidate, same_quality, case when n_task >= 3 then 'task_original_side' else 'task_family_side' end || case when use_quality then '_quality' else '' end as match_level from (select *, (case when n_task >= 3 then n_task else n_family end) >= 3 and (case when n_task >= 3 then n_task_quality else n_family_quality end) >= 3 as use_quality
        from (select *, sum(case when same_task then 1 else 0 end) over w as n_task, sum(case when same_family then 1 else 0 end) over w as n_family, sum(case when same_task and same_quality then 1 else 0 end) over w as n_task_quality, sum(case when same_family and same_quality then 1 else 0 end) over w as n_family_quality
        from {pool_tiers} where not same_subject window w as (partition by query)) a) b where (case when n_task >= 3 then same_task else same_family end) and (not use_quality or same_quality)""",
    "base_candidates": "select query, candidate, match_level, false as is_true, count(*) over (partition by query) + 1 as n_candidates from {matched_pool} union all select pair_id, pair_id, 'true_pair', true, 1 + coalesce(n, 0) from {state_pairs} left join (select query, count(*) as n from {matched_pool} group by query) k on pair_id = query",
    "pool_conditions": """select 'original' as condition, query, candidate from {base_candidates} union all select 'task_side_quality_ignored', query, candidate from {pool_tiers} where not same_subject and same_task or query = candidate
        union all select 'task_side_quality_strict', query, candidate from {pool_tiers} where not same_subject and same_task and same_quality or query = candidate union all select 'same_subject_added', query, candidate from {base_candidates}
        union all select 'same_subject_added', q.pair_id, c.pair_id from {state_pairs} q join {state_pairs} c on q.subject = c.subject and q.task <> c.task union all select 'family_side', query, candidate from {pool_tiers} where not same_subject and same_family or query = candidate
        union all select 'side_only', query, candidate from {pool_tiers} where not same_subject or query = candidate union all select 'all', q.pair_id, c.pair_id from {state_pairs} q cross join {state_pairs} c""",
    "pool_sizes": "select condition, count(*) as n_queries, round(avg(n), 6) as mean_size, min(n) as least, max(n) as most, round(avg(1.0 / n), 6) as chance_top1 from (select condition, query, count(*) as n from {pool_conditions} group by condition, query) k group by condition",
    "pool_context": "select condition, p.query, count(*) as n_candidates, cast(sum(case when q.subject = c.subject and q.pair_id <> c.pair_id then 1 else 0 end) as bigint) as n_same_subject, cast(sum(case when q.task = c.task then 1 else 0 end) as bigint) as n_same_task, cast(sum(case when q.quality = c.quality then 1 else 0 end) as bigint) as n_same_quality from {pool_conditions} p join {state_pairs} q on p.query = q.pair_id join {state_pairs} c on p.candidate = c.pair_id group by condition, p.query",
    "hard_negatives": "select q.pair_id as query, c.pair_id as candidate, case when q.subject = c.subject then 'same_subject_wrong_task' else 'other_subject_same_task' end as kind from {state_pairs} q join {state_pairs} c on q.pair_id <> c.pair_id and (q.subject = c.subject or q.task = c.task)",
}

QUERIES = [k for k in BOOK if k not in ("recordings", "channels", "feature_names", "windows", "pool_tiers")]
