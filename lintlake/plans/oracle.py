"""SQL for DuckDB that gives the rows of the queries of this folder, written on its own from the tables."""

from __future__ import annotations

from lintlake.operators import dims, rules, texts

_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)

FACTS = """facts as (select issue_id, any_value(file_path) as file_path, any_value(rule_name) as rule_name, any_value(line) as line, any_value(emit_seq) as emit_seq, any_value(subject) as subject, any_value(message) as message,
    case lower(trim(any_value(severity))) when 'nuclear' then 'Nuclear' when 'spicy' then 'Spicy' when 'mild' then 'Mild' end as severity from issues group by issue_id)"""
FILES = r"""files as (select file_path, content, line_count, byte_ok, byte_ok and parse_ok as parse_ok from (
    select file_path, case when ok then content end as content, ok as byte_ok, coalesce(parse_ok, false) as parse_ok,
    case when ok then length(content) - length(replace(content, chr(10), '')) + case when content <> '' and not ends_with(content, chr(10)) then 1 else 0 end else 0 end as line_count
    from (select *, coalesce(byte_ok, false) and content is not null as ok from (select file_path, any_value(content) as content, any_value(byte_ok) as byte_ok, any_value(parse_ok) as parse_ok
    from source_files where regexp_matches(file_path, '[^/]\.rs$') group by file_path)))),
    parsed as (select * from files where parse_ok)"""
_TRIM = r"regexp_replace({}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"
LINES = f"""lines as (select file_path, line_no, raw, {_TRIM.format("raw")} as trimmed from (
    select file_path, unnest(parts) as raw, generate_subscripts(parts, 1) as line_no, len(parts) as n, content from (select file_path, content, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) as parts from parsed))
    where not (line_no = n and raw = ''))"""
_RANK = "case severity when 'Nuclear' then 3 when 'Spicy' then 2 when 'Mild' then 1 end"
_BASE = r"regexp_extract(file_path, '[^/]*$')"
_COUNTS = "count(*) as n_issues, count(*) filter (where severity = 'Nuclear') as n_nuclear, count(*) filter (where severity = 'Spicy') as n_spicy, count(*) filter (where severity = 'Mild') as n_mild"
_values = lambda d: ", ".join(f"('{k}', {v}::double)" for k, v in d.items())
WEIGHTS = f"""rule_weights(rule_name, rw) as (values {_values(dims.RULE_WEIGHTS)}), severity_weights(severity, sw) as (values {_values(dims.SEVERITY_WEIGHTS)}),
    weighed as (select *, coalesce(rw, 1) * coalesce(sw, 1) as w from facts left join rule_weights using (rule_name) left join severity_weights using (severity))"""
CATEGORIES = f"""categories(category, weight, good, average, poor) as (values {", ".join(str((k, *v[:4])) for k, v in dims.CATEGORIES.items())}),
    members(rule_name, category) as (values {", ".join(str((r, k)) for k, v in dims.CATEGORIES.items() for r in v[4])})"""


def _scores(groups: str, lines: str, on: str) -> str:
    key = f"{on}, " if on else ""
    join = f"using ({on})" if on else "on true"
    return f"""counted as (select {key}category, count(*) as n from facts join members using (rule_name) group by all),
        rows as (select {key}category, weight, good, average, poor, coalesce(n, 0) as n, total_lines from {groups} cross join categories left join counted using ({key}category) left join {lines} {join}),
        dense as (select *, case when total_lines > 0 then n / total_lines * 1000 else 0 end as d from rows),
        scores as (select {key}category, weight, n, case when coalesce(total_lines, 0) = 0 or d <= 0 then 0 when d <= good then d / good * 20 when d <= average then 20 + (d - good) / (average - good) * 20
            when d <= poor then 40 + (d - average) / (poor - average) * 20 else least(60 + 2 * (d - poor), 90) end as score from dense)"""


_LEVEL = "case when trunc({0}) <= 20 then 'Excellent' when trunc({0}) <= 40 then 'Good' when trunc({0}) <= 60 then 'Average' when trunc({0}) <= 80 then 'Poor' else 'Terrible' end"
_WHOLE = _scores("(select 1 as one)", "(select sum(line_count) as total_lines from files)", "")
_EACH = _scores("(select distinct file_path from facts where file_path is not null)", "(select file_path, line_count as total_lines from files)", "file_path")
_FAMILY = "case " + " ".join(f"when {' or '.join(f'contains(rule_name, {chr(39)}{p}{chr(39)})' for p in parts)} then '{name}'" for name, parts in dims.FAMILIES) + " else 'Other Issues' end"
_ENTRIES = f"entries as (select file_path, {_COUNTS}, 10.0 * count(*) filter (where severity = 'Nuclear') + 3 * count(*) filter (where severity = 'Spicy') + count(*) filter (where severity = 'Mild') as shame_score from facts group by file_path)"


_PICKS = "pools(category, pool) as (values " + ", ".join(f"('{name}', [{', '.join(chr(39) + x + chr(39) for x in pools['en-US'])}])" for name, pools in texts.REMARKS.items()) + ")"


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


SQL = {
    "scan_line_metrics": _with(FILES) + "select count(*) as n_files, sum(line_count) as n_lines, count(*) filter (where byte_ok) as n_readable, count(*) filter (where parse_ok) as n_parsed from files",
    "file_line_counts": _with(FILES) + "select file_path, line_count from files",
    "extension_filter": r"select distinct file_path from source_files where regexp_matches(file_path, '[^/]\.rs$')",
    "exclude_glob_filter": r"""select distinct file_path from source_files where not regexp_matches(file_path, '(vendor/.*|.*/generated/.*|target/.*|.*\.pb\.rs|test_.*)')""",
    "harsh_filter": _with(FACTS) + "select issue_id, severity from facts where severity in ('Nuclear', 'Spicy')",
    "severity_distribution": _with(FACTS) + f"select {_COUNTS} from facts",
    "severity_by_rule": _with(FACTS) + f"select rule_name, {_COUNTS} from facts group by rule_name",
    "issue_density": _with(FACTS, FILES) + "select round((select count(*) from facts) / sum(line_count) * 1000, 6) as density from files",
    "category_counts": _with(FACTS, CATEGORIES) + "select category, count(f.rule_name) as n_issues from categories left join members m using (category) left join facts f on f.rule_name = m.rule_name group by category",
    "category_scores": _with(FACTS, FILES, CATEGORIES, _WHOLE) + "select category, weight::double as category_weight, n as n_issues, round(score, 6) as category_score from scores",
    "total_score": _with(FACTS, FILES, CATEGORIES, _WHOLE) + f"select round(s, 6) as total_score, {_LEVEL.format('s')} as quality_level from (select sum(score * weight) / sum(weight) as s from scores)",
    "score_per_file": _with(FACTS, FILES, CATEGORIES, _EACH) + f"select file_path, round(s, 6) as total_score, {_LEVEL.format('s')} as quality_level from (select file_path, sum(score * weight) / sum(weight) as s from scores group by file_path)",
    "worst_categories": _with(FACTS, FILES, CATEGORIES, _WHOLE) + "select category, round(score, 6) as category_score from scores order by score desc, category limit 5",
    "score_suggestions": _with(FACTS, FILES, CATEGORIES, _WHOLE) + "select category, round(score, 6) as category_score from scores where score > 60 order by score desc, category limit 3",
    "base_score": _with(FACTS, WEIGHTS) + "select round(sum(w), 6) as base_score from weighed",
    "base_score_breakdown": _with(FACTS, WEIGHTS) + "select rule_name, count(*) as n_issues, round(sum(w), 6) as weighted from weighed group by rule_name order by sum(w) desc, rule_name limit 10",
    "raw_category_scores": _with(FACTS, WEIGHTS, CATEGORIES) + "select category, round(sum(w), 6) as weighted from weighed join members using (rule_name) group by category",
    "rule_dim_weights": """with r as (select rule_name, coalesce(any_value(weight), 1.0) as weight from rule_dim group by rule_name), f as (select issue_id, any_value(rule_name) as rule_name from issues group by issue_id)
        select f.rule_name, count(*) as n_issues, round(sum(coalesce(weight, 1.0)), 6) as weighted from f left join r using (rule_name) group by f.rule_name""",
    "density_penalty": _with(FACTS, FILES) + """select file_path, (case when d > 50 then 25.0 when d > 30 then 15 when d > 20 then 10 when d > 10 then 5 else 0 end + case when n > 20 then 15 when n > 10 then 10 when n > 5 then 5 else 0 end)::double as penalty
        from (select file_path, count(*) as n, count(*) / any_value(line_count) * 1000 as d from facts join files using (file_path) where line_count > 0 group by file_path)""",
    "severity_penalty": _with(FACTS) + f"""select file_path, (case when n_nuclear > 0 then 20.0 + 5 * (n_nuclear - 1) else 0 end + case when n_spicy > 5 then 2.0 * (n_spicy - 5) else 0 end + case when n_mild > 20 then 0.5 * (n_mild - 20) else 0 end)::double as penalty
        from (select file_path, {_COUNTS} from facts group by file_path)""",
    "shame_entries": _with(FACTS, _ENTRIES) + "select file_path, n_issues, n_nuclear, n_spicy, n_mild, shame_score::double as shame_score from entries",
    "shame_top10": _with(FACTS, _ENTRIES) + "select file_path, shame_score::double as shame_score from entries where file_path is not null order by shame_score desc, file_path limit 10",
    "worst_offenses": _with(FACTS) + "select file_path, rule_name, severity from facts where severity in ('Nuclear', 'Spicy')",
    "pattern_stats": _with(FACTS) + f"select rule_name, {_COUNTS}, count(distinct file_path) as n_files from facts group by rule_name",
    "pattern_examples": _with(FACTS) + "select rule_name, file_path, row_number() over (partition by rule_name order by file_path) as position from (select distinct rule_name, file_path from facts where file_path is not null) qualify position <= 5",
    "top_patterns": _with(FACTS) + "select rule_name, count(*) as n_issues from facts where rule_name is not null group by rule_name order by n_issues desc, rule_name limit 10",
    "shame_density": _with(FACTS, FILES) + """select sum(n)::bigint as n_issues, count(*) as n_files, coalesce(sum(line_count), 0)::bigint as n_lines, round(sum(n) / sum(line_count) * 1000, 6) as density
        from (select file_path, count(*) as n from facts group by file_path) left join files using (file_path)""",
    "shame_families": _with(FACTS) + f"select {_FAMILY} as family, count(*) as n_issues from facts group by 1",
    "shame_heatmap": _with(FACTS, _ENTRIES) + r"select regexp_replace(case when contains(file_path, '/') then file_path when file_path is not null then '/' end, '/[^/]*$', '') as directory, sum(shame_score)::double as shame_score from entries group by 1",
    "top_files": _with(FACTS) + f"select {_BASE} as file_name, count(*) as n_issues from facts where file_path is not null group by 1 order by 2 desc, 1 limit 5",
    "rule_groups_per_file": _with(FACTS) + f"select {_BASE} as file_name, rule_name, count(*) as n_issues, max({_RANK}) as worst, row_number() over (partition by {_BASE} order by max({_RANK}) desc nulls last, rule_name) as position from facts where file_path is not null and rule_name is not null group by 1, 2 qualify position <= 5",
    "rule_groups_by_count": _with(FACTS) + f"select {_BASE} as file_name, rule_name, count(*) as n_issues, row_number() over (partition by {_BASE} order by count(*) desc, rule_name) as position from facts where file_path is not null and rule_name is not null group by 1, 2",
    "issues_per_file_topn": _with(FACTS) + f"select {_BASE} as file_name, issue_id, row_number() over (partition by {_BASE} order by {_RANK} desc nulls last, emit_seq, issue_id) as position from facts where file_path is not null qualify position <= 5",
    "severity_sorted_issues": _with(FACTS) + f"select issue_id, {_RANK} as severity_rank, row_number() over (order by {_RANK} desc nulls last, emit_seq, issue_id) as position from facts",
    "distinct_rules": "select distinct rule_name from issues",
    "distinct_files": "select count(distinct file_path) as n_files from issues",
    "exclude_patterns_by_owner": r"""with owners as (select distinct coalesce(owner, chr(0)) as o from exclude_patterns),
        globs as (select coalesce(owner, chr(0)) as o, replace(replace(replace(pattern, '.', '\.'), '*', '.*'), '?', '.') as x from exclude_patterns where pattern is not null and pattern not in ('[broken', '(')),
        each as (select o, string_agg('(' || x || ')', '|') as x from globs group by o),
        paths as (select distinct file_path from source_files where file_path is not null)
        select nullif(o, chr(0)) as owner, file_path from owners left join each using (o), paths where x is null or not regexp_matches(file_path, x)""",
    "anonymous_stats": _with(FACTS) + "select 'Developer_' || (('0x' || substr(md5(file_path), 1, 8))::bigint % 2147483648) % 100 as developer, count(*) as n_issues from facts where file_path is not null group by 1",
    "analysis_keys": "select 0::bigint as shared_keys, 0::bigint as shared_ids",
    "category_status": _with(FACTS, FILES, CATEGORIES, _WHOLE, _PICKS) + """select category, case when trunc(score) between 81 and 100 then 'Terrible, urgent fixes needed' when trunc(score) between 61 and 80 then 'Poor, refactoring recommended'
        when trunc(score) between 41 and 60 then 'Average, needs improvement' when trunc(score) between 21 and 40 then 'Good, room for improvement' else 'Excellent, keep it up' end as status,
        case when score >= 60 then coalesce(pool[(('0x' || substr(md5('7:' || category), 1, 8))::bigint % 2147483648) % len(pool) + 1], 'Code needs improvement') end as remark from scores left join pools using (category)""",
    "remark_picks": _with(FACTS, _PICKS) + """select file_path, pool[(('0x' || substr(md5(n || ':duplication'), 1, 8))::bigint % 2147483648) % len(pool) + 1] as remark
        from (select file_path, count(*) as n from facts group by file_path), pools where category = 'duplication'""",
    "rule_group_details": "with " + FACTS + rf""", named as (select *, {_BASE} as file_name, {_RANK} as rank, contains(rule_name, 'naming') or contains(rule_name, 'single-letter') as naming,
        case when contains(rule_name, 'nesting') then coalesce(case when regexp_matches(subject, '^\d{{1,9}}$') then subject::int end, nullif(regexp_extract(coalesce(message, ''), '(?:depth|深度): (\d+)', 1), '')::int) end as depth
        from facts where file_path is not null and rule_name is not null),
        firsts as (select file_name, rule_name, string_agg(subject, ', ' order by place) as names, count(*) as n_named from (select *, row_number() over (partition by file_name, rule_name order by rank desc nulls last, emit_seq, issue_id) as place from named where naming and subject is not null) where place <= 5 group by all)
        select g.* exclude (naming), coalesce(names, '') as names, naming and coalesce(n_named, 0) < n_issues as more_names from (select file_name, rule_name, count(*) as n_issues, max(rank) as worst, min(depth) as least_depth, max(depth) as greatest_depth, any_value(naming) as naming from named group by all) g
        left join firsts using (file_name, rule_name)""",
    "rule_counts": _with(FACTS) + "select rule_name, count(*) as n_issues from facts group by 1",
}

# Rules on whole texts and lines


def _n(*literals: str) -> str:
    return " + ".join(f"((length(content) - length(replace(content, '{x}', ''))) // {len(x)})" for x in literals)


def _text_rule(rule: str, measures: list[tuple[tuple[str, ...], int, str, str]]) -> str:
    parts = [f"select file_path, 1 as line, 1 as col, '{rule}' as rule_name, {severity} as severity, '{roast}' as roast_level, n::varchar as subject from (select file_path, {_n(*literals)} as n from parsed) where n > {limit}" for literals, limit, severity, roast in measures]
    return _with(FILES) + " union all ".join(parts)


_LOOKS = " + ".join(f"contains(body, '{s}')::int" for s in rules.CODE_SIGNS)
_WORDS = " or ".join(f"contains(body, '{s}')" for s in rules.CODE_WORDS)
_DEAD = " or ".join(f"contains(trimmed, '{s}')" for s in rules.DEAD_ENDS)
_USES = f"uses as (select file_path, list_filter(list_transform(string_split(content, chr(10)), lambda x: rtrim(x, chr(13))), lambda x: starts_with({_TRIM.format('x')}, 'use ')) as u from parsed)"

SQL |= {
    "rule_todo_comment": _text_rule("todo-comment", [(tuple(rules.TODO_MARKS), 5, "case when n > 10 then 'Spicy' else 'Mild' end", "Sarcastic")]),
    "rule_vec_abuse": _text_rule("vec-abuse", [(("Vec::new()",), 3, "'Mild'", "Gentle")]),
    "rule_box_abuse": _text_rule("box-abuse", [(("Box::new", "Box<"), 8, "'Spicy'", "Sarcastic")]),
    "rule_commented_code": _with(FILES, LINES) + f"""
        , marked as (select *, starts_with(trimmed, '//') as comment, {_TRIM.format("regexp_replace(trimmed, '^(//)+', '')")} as body from lines),
        coded as (select *, comment and (({_LOOKS}) >= 2 or {_WORDS}) as code from marked),
        runs as (select *, sum(case when code then 0 else 1 end) over (partition by file_path order by line_no) as run, lead(comment) over (partition by file_path order by line_no) as next_comment from coded)
        select file_path, (min(line_no) - case when arg_max(coalesce(next_comment, false), line_no) then 0 else 1 end)::int as line, 1 as col, 'commented-code' as rule_name, case when count(*) > 10 then 'Spicy' else 'Mild' end as severity,
        'Sarcastic' as roast_level, count(*)::varchar as subject from runs where code group by file_path, run having count(*) >= 3""",
    "rule_dead_code": _with(FILES, LINES) + f"select file_path, line_no::int as line, 1 as col, 'dead-code' as rule_name, 'Mild' as severity, 'Sarcastic' as roast_level, trimmed as subject from lines where {_DEAD}",
    "rule_line_duplication": _with(FILES, LINES) + r"""select file_path, min(line_no)::int as line, count(*) as n_lines, case when count(*) >= 5 then 'Nuclear' when count(*) = 4 then 'Spicy' else 'Mild' end as severity
        from lines where strlen(trimmed) >= 10 and not starts_with(trimmed, '//') and not starts_with(trimmed, '/*') group by file_path, lower(replace(replace(regexp_replace(trimmed, '[\s\x0b\x{85}\p{Z}]', '', 'g'), 'let', 'VAR'), 'mut', '')) having count(*) >= 3""",
    "rule_file_structure": _with(FILES) + "select file_path, 1 as line, 1 as col, 'file-too-long' as rule_name, case when line_count > 2000 then 'Nuclear' when line_count > 1500 then 'Spicy' else 'Mild' end as severity, 'Sarcastic' as roast_level, line_count::varchar as subject from parsed where line_count > 1000",
    "rule_import_chaos": _with(FILES, _USES) + """select file_path, 1 as line, 1 as col, 'unordered-imports' as rule_name, 'Mild' as severity, 'Sarcastic' as roast_level, null::varchar as subject from uses where len(u) > 1 and u <> list_sort(u)
        union all select file_path, 1, 1, 'duplicate-imports', 'Mild', 'Sarcastic', null from (select file_path, unnest(generate_series(1, len(u) - len(list_distinct(u)))) from uses where len(u) > 1)""",
}

# Rules on tokens: the text cut by one pattern, comments dropped, bodies of macro calls masked by the range of their brackets

_PATTERN = r"""r#*"[^"]*"#*|b?"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\])'|'[A-Za-z_][A-Za-z0-9_]*|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|[0-9][A-Za-z0-9_]*(?:\.[0-9][0-9A-Za-z_]*)?|[A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_]""".replace("'", "''")
_KEYWORDS = _quoted("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while _".split())
TOKENS = rf"""cut as (select file_path, regexp_extract_all(content, '{_PATTERN}') as ts from parsed),
    numbered as (select file_path, t, row_number() over (partition by file_path order by i) as i from (select file_path, unnest(ts) as t, generate_subscripts(ts, 1) as i from cut) where not starts_with(t, '//') and not starts_with(t, '/*')),
    tokens as (select *, lag(t) over w as p1, lag(t, 2) over w as p2, lead(t) over w as n1, lead(t, 2) over w as n2, sum(case when t in ('(', '[', '{{') then 1 when t in (')', ']', '}}') then -1 else 0 end) over w as depth from numbered window w as (partition by file_path order by i)),
    opened as (select file_path, i, depth, 'macro' as kind from tokens where t in ('(', '[', '{{') and p1 = '!' and regexp_matches(p2, '^[A-Za-z_]') and p2 not in ({_KEYWORDS})
        union all select a.file_path, min(b.i), a.depth + 1, 'impl' from tokens a join tokens b on a.file_path = b.file_path and b.i > a.i and b.t = '{{' and b.depth = a.depth + 1 where a.t in ('impl', 'trait') group by a.file_path, a.i, a.depth),
    ranges as (select o.file_path, o.kind, o.i as a, min(t.i) as b, any_value(o.depth) as depth from opened o join tokens t on t.file_path = o.file_path and t.i > o.i and t.depth < o.depth group by all),
    masked as (select distinct t.file_path, t.i from tokens t join ranges r on r.file_path = t.file_path and r.kind = 'macro' and t.i > r.a and t.i <= r.b),
    kept as (select * from tokens anti join masked using (file_path, i)),
    idents as (select file_path, i, ltrim(t, '''') as name, p1, n1 from kept where (regexp_matches(t, '^[A-Za-z_]') or regexp_matches(t, '^''[A-Za-z_][A-Za-z0-9_]*$')) and t not in ({_KEYWORDS}))"""


def _idents(rule: str, where: str, severity: str, roast: str, subject: str = "name") -> str:
    return _with(FILES, TOKENS) + f"select file_path, 1 as line, 1 as col, '{rule}' as rule_name, {severity} as severity, '{roast}' as roast_level, {subject} as subject from idents where {where}"


def _nth(rule: str, where: str, limit: int, severity: str, roast: str) -> str:
    return _with(FILES, TOKENS) + f"""select file_path, 1 as line, 1 as col, '{rule}' as rule_name, {severity} as severity, {roast} as roast_level, nth::varchar as subject
        from (select *, row_number() over (partition by file_path order by i) as nth from kept where {where}) where nth > {limit}"""


_CALL = "p1 = '.' and (n1 = '(' or n1 = ':' and n2 = ':') and t = '{}'"
_EMPTY = r"regexp_matches(lower(name), '^(data|info|temp|tmp|val|value|item|thing|stuff|obj|object|manager|handler|helper|util|utils|a|b|c|d|e|f|g|h|test|func|function)([0-9]+)?$')"
_ABBREVIATIONS = "abbreviations(abbreviation, meant) as (values " + ", ".join(str(x) for x in rules.ABBREVIATIONS.items()) + ")"

SQL |= {
    "rule_meaningless_naming": _idents("meaningless-naming", f"lower(name) in ({_quoted(rules.MEANINGLESS)})", f"case when name in ({_quoted(rules.WORST_MEANINGLESS)}) then 'Spicy' else 'Mild' end", "Sarcastic"),
    "rule_hungarian_notation": _idents("hungarian-notation", r"regexp_matches(name, '^(" + "|".join(rules.HUNGARIAN) + r")(\p{Lu}|_)')", "'Mild'", "Sarcastic"),
    "rule_abbreviation_abuse": _with(FILES, TOKENS, _ABBREVIATIONS) + """select file_path, 1 as line, 1 as col, 'abbreviation-abuse' as rule_name, 'Mild' as severity, 'Gentle' as roast_level, name || ' -> ' || meant as subject
        from idents join abbreviations on abbreviation = regexp_extract(lower(name), '^([^_]+)', 1)""",
    "rule_terrible_naming": _with(FILES, TOKENS) + f"""select file_path, (row_number() over (partition by file_path order by i) + 1)::int as line, (strlen(name) % 10 + 1)::int as col, 'terrible-naming' as rule_name, 'Spicy' as severity, 'Sarcastic' as roast_level, name as subject
        from (select file_path, i * 2 as i, name from idents union all
            select f.file_path, i * 2 - 1, name from idents f where p1 = 'fn' and not exists (select 1 from ranges r join tokens t on t.file_path = r.file_path where r.kind = 'impl' and r.file_path = f.file_path and t.i = f.i and f.i > r.a and f.i < r.b and t.depth = r.depth)) where {_EMPTY}""",
    "rule_unwrap_abuse": _nth("unwrap-abuse", _CALL.format("unwrap"), 0, "case when nth > 5 then 'Nuclear' when nth > 2 then 'Spicy' else 'Mild' end", "case when nth > 5 then 'Savage' when nth > 2 then 'Sarcastic' else 'Gentle' end"),
    "rule_unnecessary_clone": _nth("unnecessary-clone", _CALL.format("clone"), 3, "'Spicy'", "'Sarcastic'"),
    "rule_macro_abuse": _nth("macro-abuse", f"regexp_matches(t, '^[A-Za-z_]') and t not in ({_KEYWORDS}) and n1 = '!' and n2 in ('(', '[', '{{')", 10, "'Mild'", "'Gentle'"),
    "rule_lifetime_abuse": _nth("lifetime-abuse", "regexp_matches(t, '^''[A-Za-z_][A-Za-z0-9_]*$')", 5, "'Spicy'", "'Sarcastic'"),
    "rule_dyn_trait_abuse": _nth("dyn-trait-abuse", "t = 'dyn'", 5, "'Spicy'", "'Sarcastic'"),
}

_CALLS = """calls as (select n.file_path, n.t as name, n.p1 in ('{', '}', ';') and after.t = ';' as statement from ranges r join kept n on n.file_path = r.file_path and n.i = r.a - 2
    left join tokens after on after.file_path = r.file_path and after.i = r.b + 1 where r.kind = 'macro')"""
_ROW = "1 as line, 1 as col, '{}' as rule_name, {} as severity, '{}' as roast_level"


def _macro(rule: str, macro: str, severity: str, roast: str) -> str:
    return f"select file_path, {_ROW.format(rule, severity, roast)}, name as subject from calls where name = '{macro}' and not coalesce(statement, false)"


def _over(rule: str, literals: list[str], limit: int, severity: str, roast: str) -> str:
    return f"select file_path, {_ROW.format(rule, severity, roast)}, n::varchar as subject from (select file_path, {_n(*literals)} as n from parsed) where n > {limit}"


_VALUE = "case when starts_with(t, '0x') then try_cast(regexp_replace(replace(t, '_', ''), '[iu](8|16|32|64|128|size)$', '') as hugeint) else try_cast(regexp_replace(replace(t, '_', ''), '[iu](8|16|32|64|128|size)$', '') as hugeint) end"
SQL |= {
    "rule_println_debugging": _with(FILES, TOKENS, _CALLS) + _macro("println-debugging", "println", "'Mild'", "Gentle") + " union all " + _over("println-debugging", ["println!"], 5, "'Spicy'", "Savage"),
    "rule_panic_abuse": _with(FILES, TOKENS, _CALLS)
    + " union all ".join([_macro("panic-abuse", "panic", "'Spicy'", "Sarcastic"), _over("panic-abuse", ["panic!"], 2, "'Nuclear'", "Savage"), _over("panic-abuse", [".unwrap()"], 3, "'Spicy'", "Sarcastic")]),
    "rule_iterator_abuse": _with(FILES, TOKENS) + f"select file_path, {_ROW.format('iterator-abuse', chr(39) + 'Mild' + chr(39), 'Gentle')}, null::varchar as subject from kept where t = 'for' and regexp_matches(n1, '^[A-Za-z_]') and n1 <> '_' and n2 = 'in'",
    "rule_magic_number": _with(FILES, TOKENS) + f"""select file_path, {_ROW.format("magic-number", "case when v > 1000 then 'Spicy' else 'Mild' end", "Gentle")}, v::varchar as subject
        from (select file_path, {_VALUE} as v from kept where regexp_matches(t, '^[0-9]') and not contains(t, '.') and not (p1 = '.' and coalesce(p2, '') <> '.') and not (n1 = '=' and n2 = '>')) where v is not null and v < 9223372036854775808 and v not in (0, 1, 2, 10, 100, 1000)""",
    "rule_ffi_abuse": _with(FILES) + " union all ".join([_over("ffi-abuse", rules.C_OPERATIONS, 10, "'Nuclear'", "Savage"), _over("ffi-abuse", rules.LIBRARY_LOADS, 0, "'Spicy'", "Sarcastic"), _over("ffi-abuse", ["#[repr(C)]"], 5, "'Spicy'", "Sarcastic")]),
    "rule_unsafe_abuse": _with(FILES, TOKENS) + f"""select file_path, {_ROW.format("unsafe-abuse", "case when nth <= 3 then 'Spicy' else 'Nuclear' end", "Savage")}, nth::varchar as subject
        from (select file_path, row_number() over (partition by file_path order by i) as nth from kept where t = 'unsafe' and n1 = '{{') union all """
    + " union all ".join([_over("unsafe-abuse", ["*const", "*mut"], 5, "'Nuclear'", "Savage"), _over("unsafe-abuse", rules.DANGEROUS, 3, "'Nuclear'", "Savage")]),
    "improvement_suggestions": _with(FACTS, FILES) + """, stats as (select rule_name, count(*) as n from facts where rule_name is not null group by 1), top as (select *, row_number() over (order by n desc, rule_name) as position from stats),
        dense as (select sum(n) / sum(line_count) * 1000 as d from (select file_path, count(*) as n from facts where rule_name is not null group by 1) left join files using (file_path))
        select position::int as position, rule_name, case when contains(rule_name, 'naming') then 'Choose names that say what a thing is for' when contains(rule_name, 'unwrap') then 'Handle the error case instead of unwrapping'
            when contains(rule_name, 'complexity') or contains(rule_name, 'nesting') then 'Split deep and long functions into small ones' when contains(rule_name, 'println') then 'Log through a logging crate instead of printing'
            when contains(rule_name, 'clone') then 'Borrow where a clone isn''t needed' else 'Work through the ' || n || ' findings of ' || rule_name end as suggestion from top where position <= 3
        union all select 4, null, 'More than 50 findings in a thousand lines: plan a clean-up' from dense where d > 50""",
}

# Rules on the structure around a token: where its bracket opens and closes, and what encloses it

FUNCTIONS = """angled as (select *, sum(case when t = '<' then 1 when t = '>' and coalesce(p1, '') not in ('-', '=') then -1 else 0 end) over (partition by file_path order by i) as angle,
        concat_ws(' ', p2, p1, '') as before, lag(t, 3) over w as p3, lag(t, 4) over w as p4 from tokens window w as (partition by file_path order by i)),
    heads as (select a.* from angled a semi join kept k using (file_path, i) where t = 'fn' and regexp_matches(n1, '^[A-Za-z_]')),
    free as (select * from heads f where not exists (select 1 from ranges r join tokens x on x.file_path = r.file_path where r.kind = 'impl' and r.file_path = f.file_path and x.i = f.i and f.i > r.a and f.i < r.b and x.depth = r.depth)),
    parens as (select f.file_path, f.i, f.n1 as name, min(x.i) as a, any_value(f.depth) as depth from free f join angled x on x.file_path = f.file_path and x.i > f.i and x.t = '(' and x.depth = f.depth + 1 and x.angle = f.angle group by all),
    closed as (select p.*, min(x.i) as b from parens p join tokens x on x.file_path = p.file_path and x.i > p.a and x.depth = p.depth group by all),
    commas as (select c.file_path, c.i, c.name, c.a, c.b, count(x.i) filter (where x.t = ',' and x.depth = c.depth + 1 and x.angle = o.angle) as commas, arg_max(x.t, x.i) as last
        from closed c join angled o on o.file_path = c.file_path and o.i = c.a left join angled x on x.file_path = c.file_path and x.i > c.a and x.i < c.b group by c.file_path, c.i, c.name, c.a, c.b),
    parameters as (select file_path, i, name, commas + case when b > a + 1 and last <> ',' then 1 else 0 end as n from commas),
    ended as (select c.file_path, c.i, min(x.i) as e from closed c join tokens x on x.file_path = c.file_path and x.i > c.b and (x.t = '{' and x.depth = c.depth + 1 or x.t = ';' and x.depth = c.depth) group by all),
    bodies as (select e.file_path, e.i, e.e, min(x.i) as z from ended e join tokens o on o.file_path = e.file_path and o.i = e.e and o.t = '{' join tokens x on x.file_path = e.file_path and x.i > e.e and x.depth = o.depth - 1 group by all)"""
_CONTROL = " + ".join(f"(length(x.t) - length(replace(x.t, '{w}', ''))) // {len(w)}" for w in ("if", "else", "for", "while", "match", "loop"))
MATCHES = """starts as (select m.file_path, m.i, min(x.i) as a, any_value(m.depth) as depth from kept m join kept x on x.file_path = m.file_path and x.i > m.i and x.t = '{' and x.depth = m.depth + 1 where m.t = 'match' group by m.file_path, m.i),
    ends as (select s.*, min(x.i) as b from starts s join tokens x on x.file_path = s.file_path and x.i > s.a and x.depth = s.depth group by all),
    inner_tokens as (select e.file_path, e.a, x.i, x.t, x.n1, x.n2, x.depth = e.depth + 1 as flat from ends e join kept x on x.file_path = e.file_path and x.i > e.a and x.i < e.b),
    cuts as (select *, flat and t = '=' and n1 = '>' as arrow, flat and (t = ',' or t = '}' and not (n1 = '=' and n2 = '>')) as cut from inner_tokens),
    arms as (select *, coalesce(sum(arrow::int) over (partition by file_path, a order by i rows between unbounded preceding and 1 preceding), 0) as nth,
        max(case when cut then i end) over (partition by file_path, a order by i) as last_cut, sum(arrow::int) over (partition by file_path, a) as n from cuts),
    patterns as (select x.file_path, x.a, any_value(x.n) as n, bool_or(contains(x.t, 'Ok')) as ok, bool_or(contains(x.t, 'Err')) as err
        from arms x join arms w on w.file_path = x.file_path and w.a = x.a and w.arrow and x.i < w.i and x.i > coalesce(w.last_cut, w.a) and x.nth = w.nth group by x.file_path, x.a)"""
_MODULES = """modules as (select o.file_path, o.i, o.depth, min(x.i) as b from kept o join tokens x on x.file_path = o.file_path and x.i > o.i and x.depth < o.depth where o.t = '{' and o.p2 = 'mod' group by all),
    nested as (select m.file_path, m.i, 1 + count(o.i) as n from modules m left join modules o on o.file_path = m.file_path and o.i < m.i and o.b > m.b group by all)"""


def _deep(rule: str, limit: int, severity: str) -> str:
    return _with(FILES, TOKENS, _MODULES) + f"select file_path, {_ROW.format(rule, severity, 'Sarcastic')}, n::varchar as subject from nested where n > {limit}"


SQL |= {
    "rule_god_function": _with(FILES, TOKENS, FUNCTIONS) + f""", controls as (select b.file_path, b.i, sum(case when x.t <> 'else' then {_CONTROL} else 0 end) + count(*) filter (where x.t = 'if') as m
            from bodies b join tokens x on x.file_path = b.file_path and x.i > b.e and x.i < b.z where regexp_matches(x.t, '^[A-Za-z_]') group by all),
        scored as (select p.file_path, p.name, 2 * greatest(p.n - 5, 0) + coalesce(m, 0) as score from parameters p left join controls using (file_path, i))
        select file_path, {_ROW.format("god-function", "case when score > 25 then 'Spicy' else 'Mild' end", "Sarcastic")}, name as subject from scored where score > 15""",
    "rule_match_abuse": _with(FILES, TOKENS, MATCHES) + f"""select file_path, {_ROW.format("match-abuse", "'Mild'", "Gentle")}, 'Option' as subject from patterns where n = 2
        union all select file_path, {_ROW.format("match-abuse", "'Mild'", "Gentle")}, 'Result' from patterns where n = 2 and ok and err""",
    "rule_async_abuse": _with(FILES, TOKENS) + f""", events as (select file_path, i, t, sum((t = 'async')::int) over w as m, sum((t = 'await')::int) over w as n from kept
            where t = 'async' and (n1 = '{{' or n1 = 'move' and n2 = '{{') or t = 'await' and p1 = '.' window w as (partition by file_path order by i))
        select file_path, {_ROW.format("async-abuse", "'Spicy'", "Sarcastic")}, m::varchar as subject from events where m > 10 union all select file_path, {_ROW.format("async-abuse", "'Mild'", "Gentle")}, n::varchar from events where n > 20""",
    "rule_module_complexity": _deep("module-complexity", 5, "'Spicy'"),
    "rule_module_nesting": _deep("deep-module-nesting", 3, "case when n > 5 then 'Spicy' else 'Mild' end"),
}
_EXTERNS = """blocks as (select o.file_path, o.i, min(x.i) as b from kept o join tokens x on x.file_path = o.file_path and x.i > o.i and x.t = '}' and x.depth = o.depth
        where o.t = 'extern' and (o.n1 = '{' or starts_with(o.n1, '"') and o.n2 = '{') group by all),
    declared as (select b.file_path, b.i, count(x.i) as n, true as block from blocks b left join tokens x on x.file_path = b.file_path and x.i > b.i and x.i < b.b and x.t = 'fn' group by all
        union all select file_path, i, 1, false from free where p1 = '"C"' and p2 = 'extern'),
    counted as (select *, sum(n) over (partition by file_path order by i) as so_far from declared)"""
SQL["rule_unsafe_abuse"] = SQL["rule_unsafe_abuse"].replace(_with(FILES, TOKENS), _with(FILES, TOKENS, FUNCTIONS)) + f""" union all select file_path, {_ROW.format("unsafe-abuse", "'Nuclear'", "Savage")}, n::varchar from (select file_path, {_n("unsafe fn")} + coalesce(m, 0) as n
    from parsed left join (select file_path, count(*) as m from free where 'unsafe' in (p1, p2, p3, p4) group by 1) using (file_path)) where n > 2"""
SQL["rule_ffi_abuse"] = SQL["rule_ffi_abuse"].replace(_with(FILES), _with(FILES, TOKENS, FUNCTIONS, _EXTERNS)) + f""" union all select file_path, {_ROW.format("ffi-abuse", "'Spicy'", "Sarcastic")}, so_far::varchar from counted where block and so_far > 10
    union all select file_path, {_ROW.format("ffi-abuse", "'Spicy'", "Sarcastic")}, n::varchar from (select file_path, count(*) as n from blocks group by 1) where n > 2"""
SQL["rule_string_abuse"] = _with(FILES, TOKENS) + f"""select file_path, {_ROW.format("string-abuse", "'Mild'", "Gentle")}, t as subject from kept where {_CALL.format("to_string")} or t = 'String' and not (n1 = ':' and n2 = ':') union all """ + _over(
    "string-abuse", ["String::new()", "String::from(", ".to_string()"], 5, "'Spicy'", "Sarcastic"
)
