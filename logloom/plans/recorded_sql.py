"""DuckDB SQL that gives the rows of the queries over recorded sessions, from the documents themselves."""

from ..functions.patterns import GENERIC_NAMES, VENDORS
from ..functions.patterns import TOOLS as BUILT_IN
from .recorded import KS, SHARES, TOOLS

# As in the SQL of the other queries.
LINES = "(case when {0} = '' then []::varchar[] when right({0}, 1) = chr(10) then string_split(left({0}, length({0}) - 1), chr(10)) else string_split({0}, chr(10)) end)"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKENS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_./:@-]{{8,}}'), lambda t: not regexp_full_match(t, '\p{{L}}+'))"


def collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def head_tail(x: str, budget: str) -> str:
    head = f"cast(floor({budget} * 0.7::double) as integer)"
    return f"(case when length({x}) <= {budget} then {x} else left({x}, {head}) || chr(10) || '[...]' || chr(10) || (case when {budget} = 0 then {x} else right({x}, {budget} - {head}) end) end)"


CALLS = f"""
docs as (select doc_id, lang, source as session_id, coalesce(text, '') as text from documents),
rec as (
  select *, doc_id % 3 <> 0 as says, sum((doc_id % 3 <> 0)::integer) over w as text_index, row_number() over w - 1 as call_index,
         coalesce(last_value(case when doc_id % 3 <> 0 then left(text, 300) end ignore nulls) over w, '') as narration,
         {listed(TOOLS)}[doc_id % 6 + 1] as tool, '/work/' || lang || '/part' || (doc_id % 17) || '.txt' as target,
         case when doc_id % 2 = 0 then 'step ' || (doc_id % 7) end as description
  from docs window w as (partition by session_id order by doc_id rows between unbounded preceding and current row)),
calls as (
  select *, row_number() over (partition by session_id order by doc_id) - 1 as call_pos, count(*) over (partition by session_id) as n_calls,
         '{{' || coalesce('"description":"' || description || '",', '') || '"file_path":"' || target || '"}}' as input_json, doc_id % 11 = 0 as is_error
  from rec where text <> ''),
texts as (select session_id, text_index - 1 as text_index, left(text, 300) as body from rec where says)"""

EVENTS = f"""{CALLS},
placed as (select t.session_id, t.text_index, body, min(call_pos) as call from texts t left join calls c on c.session_id = t.session_id and c.text_index > t.text_index group by all),
parts as (
  select session_id, coalesce(call, 1000000000) as call, 0 as step, text_index as sub, 'agent' as kind, body, null as call_pos from placed
  union all select session_id, call_pos, 1, 0, 'agent', input_json, call_pos from calls
  union all select session_id, call_pos, 2, 0, 'tool', text, call_pos from calls),
events as (select session_id, row_number() over (partition by session_id order by call, step, sub) - 1 as pos, kind, body, call_pos from parts)"""

GOALS = f"goals as (select session_id, left({collapsed('min_by(' + chr(39) + 'note ' + chr(39) + ' || left(text, 100), doc_id)')}, 2000) as goal from docs group by session_id)"

WEAK = f"""{CALLS},
facts as (
  select *, row_number() over (partition by session_id order by call_pos desc) as age, regexp_extract(target, '[^/]*$') as name,
         max(call_pos) over (partition by session_id, tool, target) > call_pos as repeated,
         tool = 'Read' and coalesce(max(case when tool in ('Edit', 'Write') then call_pos end) over (partition by session_id, target) > call_pos, false) as edited,
         list_filter(list_transform({LINES.format('text')}, lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: length(x) > 40 and length(x) < 200)[:40] as quotable
  from calls),
later as (
  select f.session_id, f.call_pos, coalesce(bool_or(len(list_filter(quotable, lambda x: contains(t.body, x))) > 0), false) as quoted, coalesce(bool_or(contains(t.body, name)), false) as named
  from facts f left join texts t on t.session_id = f.session_id and t.text_index >= f.text_index where age > 6 group by all),
inputs as (select f.session_id, f.call_pos, coalesce(bool_or(contains(c.input_json, name)), false) as given from facts f left join calls c on c.session_id = f.session_id and c.call_pos > f.call_pos where age > 6 group by all),
weak as (
  select session_id, call_pos, case when edited and not repeated then 'edited later without re-reading' when quoted then 'output quoted in later narration' when repeated then 'the agent fetched it again anyway'
                                     when named or given then 'target comes up later' else 'target never comes up again' end as why
  from facts join later using (session_id, call_pos) join inputs using (session_id, call_pos)),
labelled as (select *, case when why like 'target%' then 'proxy' else 'gold' end as kind, case when why in ('edited later without re-reading', 'output quoted in later narration', 'target comes up later') then 1 else 0 end as label from weak)"""

AT = f"""{CALLS},
points as (select c.session_id, c.call_pos, c.call_pos + 10 as now_pos, n.text_index as now_text_index, regexp_extract(c.target, '[^/]*$') as name, length(c.input_json) as n_input, length(c.text) as n_result
  from calls c join calls n on n.session_id = c.session_id and n.call_pos = c.call_pos + 10 where c.call_pos + 10 < c.n_calls - 1),
marked as (
  select *, (exists (select 1 from texts t where t.session_id = p.session_id and t.text_index >= now_text_index and contains(t.body, name))
             or exists (select 1 from calls c where c.session_id = p.session_id and c.call_pos > now_pos and contains(c.input_json, name)))::integer as label
  from points p)"""

CUTS = f"""{EVENTS},
spots as (select session_id, call_pos, pos from events where kind = 'agent' and call_pos is not null),
jobs as (
  select c.session_id, c.call_pos, k, a.pos + 2 as start, b.pos + 1 as cut, c.text as body, input_json || narration as known
  from calls c cross join (select unnest({list(KS)}) as k) join spots a on a.session_id = c.session_id and a.call_pos = c.call_pos join spots b on b.session_id = c.session_id and b.call_pos = c.call_pos + k
  where tool in ('Bash', 'Read') and length(c.text) >= 4000 and not is_error and c.call_pos + k < n_calls - 1),
lined as (select *, unnest(range(0, len({LINES.format('body')}))) as line_no, {LINES.format('body')} as lines from jobs),
tokens as (select session_id, call_pos, k, start, cut, line_no, unnest(list_distinct(list_filter({TOKENS.format('lines[line_no + 1]')}, lambda t: not contains(known, t)))) as token from lined),
seen as (select t.*, e.pos, e.kind from tokens t join events e on e.session_id = t.session_id and contains(e.body, token)),
marks as (
  select session_id, call_pos, k, line_no, token, min(pos) filter (where kind = 'agent' and pos >= cut) as first, coalesce(bool_or(kind = 'agent' and pos >= start and pos < cut), false) as own,
         min(pos) filter (where kind = 'tool' and pos >= start) as tool
  from seen group by all),
uses as (select *, case when first is null then 0 when own then 1 when tool < first then 2 else 3 end as r from marks),
needed as (select session_id, call_pos, k, line_no, max(r) as r, bool_or(own) as proven from uses group by all having max(r) > 0 or bool_or(own)),
rows as (
  select l.session_id, l.call_pos, l.k, share, l.line_no as i, length(l.lines[l.line_no + 1]) as size, length(body) as total, len(lines) as n, coalesce(proven, false)::integer as score
  from lined l cross join (select unnest({list(SHARES)}::double[]) as share) left join needed x on x.session_id = l.session_id and x.call_pos = l.call_pos and x.k = l.k and x.line_no = l.line_no),
ranked as (select *, row_number() over (partition by session_id, call_pos, k, share order by -score, least(i, n - 1 - i), i) as r from rows),
orders as (select session_id, call_pos, k, share, any_value(total) as total, list({{'i': i, 'size': size}} order by r) as x from ranked group by all),
kept as (
  select session_id, call_pos, k, share, list_reduce(list_prepend({{'used': 0::bigint, 'kept': []::bigint[]}}, list_transform(x, lambda y: {{'used': y.size::bigint, 'kept': [y.i::bigint]}})),
           lambda a, y: case when a.used + y.used + 1 <= total * share then {{'used': a.used + y.used + 1, 'kept': list_concat(a.kept, y.kept)}} else a end).kept as kept
  from orders),
cuts as (
  select n.session_id, n.call_pos, n.k, share, n.line_no, r, contains({head_tail('j.body', 'cast(floor(length(j.body) * share) as integer)')}, {LINES.format('j.body')}[n.line_no + 1]) as by_ends, list_contains(kept, n.line_no) as by_hindsight
  from needed n join jobs j on j.session_id = n.session_id and j.call_pos = n.call_pos and j.k = n.k join kept q on q.session_id = n.session_id and q.call_pos = n.call_pos and q.k = n.k where r > 0)"""
MATRIX = f"""{CUTS},
matrix as (select k, definition, share, count(*) as needed, count(*) filter (where by_ends) as by_ends, count(*) filter (where by_hindsight) as by_hindsight
from cuts join (values ('all uses', 1), ('not own', 2), ('not own/recarried', 3)) d(definition, least) on r >= least group by all)"""

RECORDED_SQL: dict[str, str] = {
    "session_scan": "select source as session_id, 2 * count(*) as n_records, cast(2 * count(*) - 1 as integer) as last_line from documents group by source",
    "session_calls": f"with {CALLS} select session_id, call_pos::integer as call_pos, call_index::integer as call_index, 'c' || doc_id as id, tool, target, input_json, length(text) as n_chars, is_error, text_index::integer as text_index, 't' || doc_id as ts, narration, case when list_contains({listed(BUILT_IN)}, tool) then tool else 'other' end as shown_tool from calls",
    "session_texts": f"with {CALLS} select session_id, text_index::integer as text_index, body from texts",
    "session_goals": f"with {CALLS}, {GOALS} select session_id, goal from goals",
    "session_events": f"with {EVENTS} select session_id, pos::integer as pos, kind, md5(body) as digest, call_pos::integer as call_pos from events",
    "raw_fields": f"with {CALLS}, {GOALS} select session_id, call_pos::integer as call_pos, goal, left(narration, 600) as said, left(input_json, 3000) as input, left(text, 1000) || chr(10) || right(text, 600) as result from calls join goals using (session_id)",
    "call_queries": f"with {CALLS} select session_id, call_pos::integer as call_pos, {collapsed('coalesce(description, target) || chr(46) || chr(32) || left(' + collapsed('narration') + ', 300)')} as query from calls",
    "next_messages": f"""with {CALLS} select c.session_id, call_pos::integer as call_pos, coalesce(left({collapsed('t.body')}, 1000), {collapsed('coalesce(description, target) || chr(46) || chr(32) || left(' + collapsed('narration') + ', 300)')}) as message
from calls c left join texts t on t.session_id = c.session_id and t.text_index = c.text_index""",
    "decision_calls": f"with {CALLS} select c.session_id, c.call_pos::integer as call_pos, n.call_pos::integer as now_pos, n.text_index::integer as now_text_index from calls c join calls n on n.session_id = c.session_id and n.call_pos = c.call_pos + 5 where n.call_pos < c.n_calls - 1",
    "weak_label_rows": f"with {WEAK} select session_id, call_pos::integer as call_pos, label, kind, why from labelled",
    "weak_label_counts": f"with {WEAK} select kind, label, why, count(*) as n from labelled group by all",
    "labels_at": f"with {AT} select session_id, call_pos::integer as call_pos, now_pos::integer as now_pos, label from marked",
    "context_areas": f"""with {AT},
scores as (select 'short input' as score, -n_input as s, label from marked union all select 'short result', -n_result, label from marked),
areas as (select a.score, sum((a.s > b.s)::integer + 0.5::double * (a.s = b.s)::integer) as won from scores a join scores b on a.score = b.score where a.label = 1 and b.label = 0 group by a.score),
sums as (select score, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives, round(stddev_pop(s), 6) as spread from (values ('short input'), ('short result')) n(score) left join scores using (score) group by score)
select score, positives, negatives, round(coalesce(won, 0) / greatest(1, positives * negatives), 9) as auc, spread from sums left join areas using (score)""",
    "retention_matrix": f"with {MATRIX} select k, definition, share, needed, by_ends, by_hindsight from matrix",
    "needed_line_kinds": f"with {CUTS} select k, case r when 3 then 'fresh' when 2 then 'recarried' else 'own' end as kind, count(*) as n from cuts where share = {SHARES[0]} group by all",
    "size_matrix": f"""with {MATRIX},
long as (select 'ends' as method, share, by_ends / needed::double as x from matrix where k = 5 and definition = 'all uses' union all select 'hindsight', share, by_hindsight / needed::double from matrix where k = 5 and definition = 'all uses')
select method, {', '.join(f'round(max(x) filter (where share = {s}), 6) as at_{round(100 * s)}' for s in SHARES)} from long group by method""",
    "retention_cases": f"""with {CUTS},
tagged as (select c.k, case r when 3 then 'fresh' when 2 then 'recarried' else 'own' end as kind, case when by_hindsight then 'won' else 'lost' end as tag, c.session_id, c.call_pos, c.line_no, {LINES.format('j.body')}[c.line_no + 1] as line
  from cuts c join jobs j on j.session_id = c.session_id and j.call_pos = c.call_pos and j.k = c.k where c.k = {KS[0]} and share = {SHARES[1]}::double and by_hindsight <> by_ends),
spaced as (select *, row_number() over (partition by kind, tag order by session_id, call_pos, line_no) - 1 as place, greatest(1, count(*) over (partition by kind, tag) // 5) as step from tagged)
select k, kind, tag, session_id, call_pos::integer as call_pos, line_no::integer as line_no, line from spaced where place % step = 0 and place // step < 5""",
    "brand_counts": f"""with h as (select page_id, string_split(lower(regexp_extract(replace(url, '.example.', '.'), '^https?://([^/?#:]*)', 1)), '.') as b from pages),
labels as (select page_id, unnest(list_distinct(list_filter(list_concat([b[-2]], list_filter(b[1 : len(b) - 2], lambda x: length(x) >= 12)), lambda x: length(x) > 3 and not list_contains({listed(GENERIC_NAMES + VENDORS)}, x)))) as label from h)
select label, count(*) as n_files from labels where label not in ('tionsh', 'example') group by label order by n_files desc, label limit 10""",
    "trim_recall": f"""with {CALLS},
jobs as (select *, {LINES.format('text')} as lines, narration || chr(10) || right(text, 400) as later from calls where tool = 'Bash' and length(text) >= 4000),
used as (select *, list_filter(list_transform(lines, lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: length(x) > 40 and length(x) < 200 and contains(later, x)) as hits, greatest(15, cast(ceil(len(lines) / 24.0) as integer)) as step from jobs),
cut as (select *, list_transform(range(0, cast(ceil(len(lines) / step::double) as integer)), lambda i: array_to_string(lines[i * step + 1 : (i + 1) * step], chr(10))) as pieces from used),
sums as (select *, list_filter(pieces, lambda x, i: (i - 1) % 3 > 0) as good, coalesce(list_sum(list_transform(list_filter(pieces, lambda x, i: (i - 1) % 3 = 0), lambda x: length(x))), 0) as dropped from cut),
trimmed as (select *, array_to_string(list_concat(good, case when dropped > 0 then ['[' || dropped::bigint || ' chars of this output were trimmed; re-run to see all of it]'] else [] end), chr(10)) as trimmed from sums),
ends as (select *, {head_tail('text', 'length(trimmed)')} as ends from trimmed)
select session_id, call_pos::integer as call_pos, length(text) as n_chars, length(trimmed) as n_trimmed, len(list_distinct(hits)) as n_used, len(list_filter(list_distinct(hits), lambda x: contains(trimmed, x))) as kept_by_score,
       len(list_filter(list_distinct(hits), lambda x: contains(ends, x))) as kept_by_ends, len(good) as n_kept, len(pieces) as n_chunks from ends""",
    "json_walk": """with d as (select doc_id, coalesce(text, '') as text, lang, source from documents)
select doc_id, unnest(['state.goal', 'state.kinds[0]', 'state.kinds[1]', 'more[0].a', 'more[0].b[0][0]']) as path, unnest([left(text, 30), lang, source, lang, source]) as value from d""",
    "line_score_means": """with d as (select doc_id, string_split(text, chr(10)) as lines from documents where length(text) between 1 and 3000),
n as (select doc_id, lines, unnest(range(0, len(lines))) as i from d),
p as (select doc_id, i, length(lines[i + 1]) as n, coalesce(list_sum(list_transform(lines[1 : i], lambda x: length(x) + 1)), 0)::bigint as spot from n)
select doc_id, i::integer as line_no, round(case when n > 0 then list_avg(list_transform(range(spot, spot + n), lambda j: j % 5)) end, 6) as mean from p""",
    "preserved_calls": f"with {CALLS} select session_id, call_pos::integer as call_pos from calls where call_pos < n_calls - 6",
}
