"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import centroids, crf_pages, edit_counts, fuzzy_lines, orc_tokens, phrases, rank_langid, simhash_tiles, suffix_dedup, temperature_mix, template_decontam, va_topk, word_windows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": rank_langid.op1_langid,
        "op2_fuzzy_lines": fuzzy_lines.op2_fuzzy_lines,
        "op3_topk": va_topk.op3_topk,
        "op4_main_text": crf_pages.op4_main_text,
        "op5_edit_counts": edit_counts.op5_edit_counts,
        "op6_simhash": simhash_tiles.op6_simhash,
        "op7_decontam": template_decontam.op7_decontam,
        "op8_mix": temperature_mix.op8_mix,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_orc_tokens": orc_tokens.op10_orc_tokens,
        "op11_word_windows": word_windows.op11_word_windows,
        "op12_phrases": phrases.op12_phrases,
        "op13_centroids": centroids.op13_centroids,
    }


#: The exact search in full: every query against every other row.
_TOPK = """with v as (select cast(vec_id as bigint) as id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as cells from embeddings
        where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as (select q.id as query_id, v.id as vec_id, cast(list_sum([q.cells[i] * v.cells[i] for i in range(1, len(q.cells) + 1)]) as bigint) as score from v q join v on v.id <> q.id where q.id % 50 = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""


#: Every window of 13 words and its smallest document.
_WINDOWS = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select doc_id, i, ws[i : i + 12] as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
    f as (select win, min(doc_id) as owner from g group by win),
    hit as (select distinct doc_id, unnest(range(i, i + 13)) as j from g join f using (win) where owner < doc_id),
    k as (select doc_id, list(j) as gone from hit group by doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
        sha256(array_to_string(case when gone is null then ws else [ws[x] for x in range(1, len(ws) + 1) if not list_contains(gone, x)] end, ' ')) as kept_sha256
    from w left join k on w.doc_id = k.doc_id"""

#: All phrases of 1 to 4 words, every cut, and containment by string search between spaces.
_PHRASES = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    s as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
    totals as (select lang, cast(sum(len(ws)) as bigint) as n from s group by lang),
    g as (select lang, size, ws[i : i + size - 1] as words from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from s, (select unnest([1, 2, 3, 4]) as size))),
    f as (select lang, size, words, count(*) as f from g group by all having count(*) >= 30),
    c as (select a.lang, a.words, a.f, k, l.f as l, r.f as r, cast((2000000 * cast(a.f as hugeint)) // (cast(l.f as hugeint) + r.f) as bigint) as score
        from (select *, unnest(range(1, size)) as k from f where size > 1) a join f l on l.lang = a.lang and l.words = a.words[1 : k] join f r on r.lang = a.lang and r.words = a.words[k + 1 :]),
    best as (select * from c qualify row_number() over (partition by lang, words order by score, k) = 1),
    inner_parts as (select lang, size, f, i, part, words[i : i + part - 1] as words from (select *, unnest(range(1, size - part + 2)) as i from f, (select unnest([2, 3]) as part) where part < size)),
    longer as (select lang, words, max(f) as f from inner_parts group by all),
    kept as (select b.lang, array_to_string(b.words, ' ') as phrase, b.f as a, b.l, b.r, b.score from best b left join longer o on o.lang = b.lang and o.words = b.words where o.f is null or 100 * cast(o.f as hugeint) < 80 * cast(b.f as hugeint))
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from kept join totals using (lang)
    qualify row_number() over (partition by lang order by score desc, a desc, encode(phrase)) <= 2000"""


def _lloyd(clusters: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Lloyd's rounds over all rows, one relation a round."""
    text = f"""with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
        where vec_id is not null and len(embedding) = {dim} and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    c0 as (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as int) as cluster, v as c from v qualify cluster < {clusters})"""
    for k in range(rounds + 1):
        text += f""",
    d{k} as (select vec_id, v, cluster, cast(list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {dim + 1})]) as bigint) as distance from v, c{k}),
    a{k} as (select * from d{k} qualify row_number() over (partition by vec_id order by distance, cluster) = 1),
    m{k} as (select cluster, list(m order by i) as m from (select cluster, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m from (select cluster, v, unnest(range(1, {dim + 1})) as i from a{k}) group by cluster, i) group by cluster),
    c{k + 1} as (select c{k}.cluster, coalesce(m, c) as c from c{k} left join m{k} on m{k}.cluster = c{k}.cluster)"""
    return text + f""" select vec_id, a{rounds}.cluster, distance, cast(sum(distance) over (partition by a{rounds}.cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
        sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.cluster = a{rounds}.cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": _TOPK, "op11_word_windows": _WINDOWS, "op12_phrases": _PHRASES, "op13_centroids": _lloyd()}
