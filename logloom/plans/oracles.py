"""DuckDB SQL that gives the rows of the queries, written on its own: naive joins where the queries use keys."""

from ..functions.patterns import GENERIC_NAMES, PUBLIC_HOSTS, VENDORS
from .queries import FIXTURE_KEY, K, LONG
from .recorded_sql import RECORDED_SQL

LINES = "(case when text = '' then []::varchar[] when right(text, 1) = chr(10) then string_split(left(text, length(text) - 1), chr(10)) else string_split(text, chr(10)) end)"
TOKENS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_./:@-]{{8,}}'), lambda t: not regexp_full_match(t, '\p{{L}}+'))"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def head_tail(x: str, budget: str) -> str:
    head = f"cast(floor({budget} * 0.7::double) as integer)"
    return f"(case when length({x}) <= {budget} then {x} else left({x}, {head}) || chr(10) || '[...]' || chr(10) || (case when {budget} = 0 then {x} else right({x}, {budget} - {head}) end) end)"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CHUNKS = f"""
docs as (select doc_id, {LINES} as lines from documents),
sized as (select *, greatest(15, cast(ceil(len(lines) / 24.0) as integer)) as step from docs),
chunked as (select doc_id, unnest(range(0, cast(ceil(len(lines) / step::double) as integer))) as chunk_no, lines, step from sized),
chunks as (select doc_id, chunk_no, array_to_string(lines[chunk_no * step + 1 : (chunk_no + 1) * step], chr(10)) as chunk from chunked)"""
LINE_TOKENS = f"""
numbered as (select doc_id, source, unnest(range(0, len(lines))) as line_no, lines from (select doc_id, source, {LINES} as lines from documents)),
lined as (select doc_id, source, line_no, lines[line_no + 1] as line from numbered),
tokens as (select doc_id, source, line_no, line, unnest(list_distinct({TOKENS.format('line')})) as token from lined)"""
USED = f"""{LINE_TOKENS},
used as (select distinct t.doc_id, line_no, line from tokens t join documents d on d.source = t.source and d.doc_id > t.doc_id and contains(d.text, token))"""
STEPS = """
steps as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case event_type when 'view' then 'Read' when 'purchase' then 'Edit' else event_type end as tool from events)"""
DECIDED = f"""{STEPS},
scored as (select *, (event_id % 100) / 100.0::double as score, (event_id % 37) / 37.0::double as call_score, length(props) + 500 as size, row_number() over (partition by user_id order by pos desc) > 6 as old from steps),
decided as (select *, case when score >= 0.5 then 'keep' when tool <> 'Read' or call_score >= 0.5 then 'truncate' else 'drop' end as action from scored),
sized as (select *, case action when 'keep' then size when 'truncate' then 300 else 0 end as kept from decided)"""
DECISION = f"jobs as (select * from (select *, lead(doc_id, {K}) over w as now, lead(doc_id, {K + 1}) over w as more from documents window w as (partition by source order by doc_id)) where more is not null)"


def fold(jobs: str, share: float) -> str:
    """Greedy filling over ranked(doc_id, i, size, score), by a walk along the ranks."""
    return f"""
ranked as (select r.*, row_number() over (partition by doc_id order by -score, least(i, n - 1 - i), i) as r from rows r),
walk(doc_id, r, used, kept) as (
  select doc_id, cast(0 as bigint), cast(0 as bigint), []::integer[] from {jobs}
  union all
  select w.doc_id, k.r, case when w.used + k.size + 1 <= k.total * {share}::double then w.used + k.size + 1 else w.used end,
         case when w.used + k.size + 1 <= k.total * {share}::double then list_append(w.kept, k.i) else w.kept end
  from walk w join ranked k on k.doc_id = w.doc_id and k.r = w.r + 1)
select doc_id, array_to_string(list_sort(max_by(kept, r)), ',') as kept from walk group by doc_id"""


def area(rows: str, score: str, label: str, digits: int) -> str:
    return f"""by_score as (select {score} as s, count(*) filter (where {label} = 1) as p, count(*) filter (where {label} = 0) as n from {rows} where {label} is not null group by 1),
won as (select p, n, p * (coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) + n / 2.0::double) as w from by_score)
select cast(sum(p) as bigint) as positives, cast(sum(n) as bigint) as negatives, round(sum(w) / greatest(1, sum(p) * sum(n)), {digits}) as auc from won"""


IPAD, OPAD = (bytes(b ^ x for b in FIXTURE_KEY.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
BUCKET = f"'host-' || left(sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(lower(host))))), 8)"

ORACLES: dict[str, str] = {
    "line_split": f"with l as (select doc_id, {LINES} as lines from documents), n as (select doc_id, lines, unnest(range(0, len(lines))) as line_no from l) select doc_id, cast(line_no as integer) as line_no, lines[line_no + 1] as line from n",
    "distinctive_tokens": f"select doc_id, cast(len({TOKENS.format('text')}) as integer) as n_tokens, array_to_string({TOKENS.format('text')}, ' ') as tokens from documents",
    "head_tail_cut": f"with b as (select doc_id, text, cast(floor(length(text) * 0.15::double) as integer) as budget from documents where length(text) >= {LONG}) select doc_id, {head_tail('text', 'budget')} as cut from b",
    "preview_cut": "select doc_id, case when length(text) <= 840 then text else left(text, 600) || chr(10) || '[... ' || (length(text) - 800) || ' chars ...]' || chr(10) || right(text, 200) end as shown from documents",
    "chunk_bounds": f"with {CHUNKS} select doc_id, cast(chunk_no as integer) as chunk_no, cast(length(chunk) as integer) as n_chars from chunks",
    "collapse_space": f"select doc_id, {collapsed('text')} as collapsed from documents",
    "chunk_trim": f"""with {CHUNKS},
sums as (select doc_id, list(chunk order by chunk_no) filter (where chunk_no % 3 > 0) as kept, coalesce(sum(length(chunk)) filter (where chunk_no % 3 = 0), 0) as dropped from chunks group by doc_id)
select d.doc_id, coalesce(array_to_string(list_concat(coalesce(kept, []), case when dropped > 0 then ['[' || dropped || ' chars of this output were trimmed; re-run to see all of it]'] else [] end), chr(10)), '') as trimmed
from documents d left join sums s on s.doc_id = d.doc_id""",
    "line_prune": f"""with l as (select doc_id, {LINES} as lines from documents), n as (select doc_id, lines, unnest(range(0, len(lines))) as i from l),
r as (select doc_id, i, lines[i + 1] as line, length(lines[i + 1]) % 7 >= 3 as good from n),
k as (select *, not regexp_full_match(line, '{SPACE}*') and (good or (coalesce(lag(good) over w, false) and coalesce(lead(good) over w, false))) as keep from r window w as (partition by doc_id order by i)),
g as (select *, sum(keep::integer) over (partition by doc_id order by i) as run, sum(keep::integer) over (partition by doc_id) as n_kept from k),
p as (select doc_id, run, max(line) filter (keep) as kept, count(*) filter (not keep) as n, sum(length(line)) filter (not keep) as chars, string_agg(line, chr(10) order by i) filter (not keep) as gone, any_value(n_kept) as n_kept from g group by doc_id, run),
q as (select doc_id, string_agg(concat_ws(chr(10), kept, case when n = 0 then null when chars > 18 or run = n_kept then '(filtered ' || n || ' lines)' else gone end), chr(10) order by run) as pruned from p group by doc_id)
select doc_id, coalesce(pruned, '') as pruned from documents left join q using (doc_id)""",
    "kept_lines": f"select doc_id, array_to_string(list_filter({LINES}, lambda x, i: i % 3 <> 2), chr(10)) as cut from documents",
    "used_lines": f"with {USED} select doc_id, cast(line_no as integer) as line_no from used",
    "head_tail_survival": f"""with {USED},
sizes as (select unnest([0.74, 0.54, 0.32]::double[]) as share),
cuts as (select share, line, text, cast(floor(length(text) * share) as integer) as budget from used join documents using (doc_id), sizes where length(text) >= {LONG})
select share, count(*) as needed, count(*) filter (where contains({head_tail('text', 'budget')}, line)) as survived, count(*) filter (where contains({head_tail('text', 'budget')}, line)) / count(*)::double as ratio from cuts group by share""",
    "overlap_selector": rf"""with recursive jobs as (select doc_id, length(text) as total, {LINES} as lines from documents where length(text) >= {LONG}),
words as (select *, list_distinct(list_transform(regexp_extract_all(lines[1], '[\p{{L}}\p{{N}}_./:@-]{{4,}}'), lambda w: lower(w))) as query, unnest(range(0, len(lines))) as i from jobs),
rows as (select doc_id, total, cast(i as integer) as i, len(lines) as n, length(lines[i + 1]) as size, len(list_intersect(list_transform(regexp_extract_all(lines[i + 1], '[\p{{L}}\p{{N}}_./:@-]{{4,}}'), lambda w: lower(w)), query)) as score from words),
{fold('jobs', 0.32)}""",
    "hindsight_selector": f"""with recursive {LINE_TOKENS}, {DECISION},
long_jobs as (select doc_id, source, now, length(text) as total, {LINES} as lines from jobs where length(text) >= {LONG}),
proven as (select t.doc_id, line_no, 1 as score from tokens t join long_jobs j on j.doc_id = t.doc_id join documents d on d.source = t.source and d.doc_id % 2 = 0 and d.doc_id > t.doc_id and d.doc_id <= j.now and contains(d.text, token) group by all),
places as (select *, unnest(range(0, len(lines))) as i from long_jobs),
rows as (select p.doc_id, total, cast(i as integer) as i, len(lines) as n, length(lines[i + 1]) as size, coalesce(score, 0) as score from places p left join proven v on v.doc_id = p.doc_id and v.line_no = p.i),
{fold('long_jobs', 0.15)}""",
    "use_kind": f"""with {DECISION},
tokens as (select doc_id, source, now, unnest(list_distinct({TOKENS.format('text')})) as token from jobs where doc_id % 2 = 1),
seen as (select t.doc_id, t.token, t.now, d.doc_id as pos, d.doc_id % 2 = 0 as agent from tokens t join documents d on d.source = t.source and contains(d.text, token)),
marks as (
  select t.doc_id, t.token, min(pos) filter (where agent and pos > t.now) as first, coalesce(bool_or(agent and pos > t.doc_id and pos <= t.now), false) as own, min(pos) filter (where not agent and pos > t.doc_id) as tool
  from tokens t left join seen s on s.doc_id = t.doc_id and s.token = t.token group by t.doc_id, t.token)
select doc_id, token, case when first is null then null when own then 'own' when tool < first then 'recarried' else 'fresh' end as use from marks""",
    "quoted_lines": f"""with l as (select distinct item_id, regexp_replace(unnest({LINES}), '^{SPACE}+|{SPACE}+$', '', 'g') as line from benchmark)
select item_id, line, doc_id from l join documents d on contains(d.text, line) where length(line) > 40 and length(line) < 200""",
    "narration_carry": """select conv_id, turn, coalesce(last_value(case when role = 'assistant' then text end ignore nulls) over w, '') as narration, coalesce(count(*) filter (where role = 'assistant') over w, 0) as text_index
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""",
    "next_message": f"""with n as (select *, first_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next from conversations)
select conv_id, turn, left({collapsed('coalesce(next, text)')}, 1000) as message from n where role <> 'assistant'""",
    "last_five_steps": f"with {STEPS} select event_id, array_to_string(list(event_type || ' ' || left(props, 90)) over (partition by user_id order by pos rows between 4 preceding and current row), chr(10)) as steps from steps",
    "repeated_calls": f"with {STEPS} select a.event_id from steps a where exists (select 1 from steps b where b.user_id = a.user_id and b.event_type = a.event_type and b.props = a.props and b.pos > a.pos)",
    "edited_not_repeated": f"""with {STEPS} select a.event_id from steps a where tool = 'Read' and exists (select 1 from steps b where b.user_id = a.user_id and b.tool = 'Edit' and b.props = a.props and b.pos > a.pos)
and not exists (select 1 from steps b where b.user_id = a.user_id and b.tool = 'Read' and b.props = a.props and b.pos > a.pos)""",
    "age_baseline": "select user_id, greatest(0, count(*) - 6) as n_dropped, count(*) as n_calls from events group by user_id",
    "decide_actions": f"with {DECIDED} select tool, action, count(*) as n, cast(sum(kept) as bigint) as retained from sized group by tool, action",
    "replay_summary": f"with {DECIDED} select user_id, cast(sum(kept) as bigint) as retained, round(avg(cast((action <> 'keep') = old as integer)), 6) as agreement, min(score) as least, max(score) as most, list_sort(list(score))[count(*) // 2 + 1] as median from sized group by user_id",
    "auc_length": f"with rows as (select n_chars, quality from labels join documents using (doc_id)), {area('rows', 'n_chars', 'quality', 9)}",
    "auc_embedding": f"""with q as (select embedding as v, label as l from embeddings order by vec_id limit 1),
rows as (select round(list_dot_product(embedding::double[], v::double[]), 6) as score, cast(label = l as integer) as same from embeddings, q), {area('rows', 'score', 'same', 6)}""",
    "vector_center_rank": """with m as (select i, avg(x::double) as m from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as x from embeddings) group by i),
mean as (select list(m order by i) as mean from m), q as (select embedding as v from embeddings order by vec_id limit 1)
select vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: (embedding[k]::double - mean[k]) * (v[k]::double - mean[k]))), 6) as score from embeddings, mean, q order by score desc, vec_id limit 20""",
    "cosine_nearest": "with q as (select embedding as v from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], v::double[]), 6) as score from embeddings, q order by score desc, vec_id limit 10",
    "stratified_sample": "select doc_id, quality from (select *, row_number() over (partition by quality order by md5(cast(doc_id as varchar))) as r from labels) where r <= 20",
    "secret_redaction": r"""with p as (select '(?i)\b(bearer|token|api[_-]?key|secret|password|passwd|pwd|auth)\b\s*[:=]\s*["'']?[\p{L}\p{N}_.\-/+=]{8,}' as p)
select doc_id, cast(len(regexp_extract_all(text, p)) as integer) as n_found, regexp_replace(text, p, '[REDACTED]', 'g') as text from documents, p""",
    "contact_counts": r"select doc_id, cast(len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]*[\p{L}\p{N}_]')) as integer) as n_emails from documents",
    "host_label_df": f"""with h as (select string_split(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.') as b from pages),
labels as (select unnest(list_distinct(list_filter(list_concat([b[-2]], list_filter(b[1 : len(b) - 2], lambda x: length(x) >= 12)), lambda x: length(x) > 3 and not list_contains({listed(GENERIC_NAMES + VENDORS)}, x)))) as label
  from h where not list_contains({listed(PUBLIC_HOSTS)}, array_to_string(b, '.')) and not list_contains({listed(PUBLIC_HOSTS)}, array_to_string(b[-2:], '.')))
select label, count(*) as n_pages from labels group by label""",
    "bucket_hosts": f"with h as (select distinct regexp_extract(url, '^https?://([^/?#:]*)', 1) as host from pages) select host, case when list_contains({listed(PUBLIC_HOSTS)}, lower(host)) then host else {BUCKET} end as shown from h where host <> ''",
} | RECORDED_SQL
