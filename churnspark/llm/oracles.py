"""DuckDB twins of the registered queries (those that SQL can express)."""

from __future__ import annotations

from churnspark.llm import licenses, lines, lm, mix, quality, urls

WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    rules = quality.RULES
    base = " or ".join(f"({rules[r]})" for r in quality.BASE_RULES)
    counts = ", ".join(f"sum(case when {sql} then 1 else 0 end) as k_{r}" for r, sql in rules.items())
    sums = ", ".join(f"sum(k_{r} / host_docs) as s_{r}, sum((k_{r} / host_docs) * (k_{r} / host_docs)) as q_{r}" for r in rules)
    means = ", ".join(f"case when hosts > 1 then (s_{r} - k_{r} / host_docs) / (hosts - 1) else k_{r} / host_docs end as m_{r}" for r in rules)
    variances = ", ".join(f"case when hosts > 2 then (q_{r} - (k_{r} / host_docs) * (k_{r} / host_docs) - (hosts - 1) * m_{r} * m_{r}) / (hosts - 2) "
                          f"else 0 end as v_{r}" for r in rules)
    strengths = ", ".join(f"case when v_{r} > {quality.FLAT} then greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0) else {quality.FLAT_STRENGTH} end as st_{r}"
                          for r in rules)
    rates = ", ".join(f"(k_{r} + m_{r} * st_{r}) / (host_docs + st_{r}) as r_{r}" for r in rules)
    worst = ", ".join(f"r_{r}" for r in rules)
    bad = " or ".join(f"r_{r} > greatest({quality.LEAST_RATE}, m_{r} + {quality.DEVIATIONS} * sqrt(greatest(0.0, m_{r} * (1 - m_{r})) / (st_{r} + 1)))" for r in rules)
    return rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, {WORDS.format(t='t')} as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
h as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from g),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n from h) where n > 1),
p as (select doc_id, count(distinct i + o) as n_repeat_words from r, (select unnest([0, 1, 2]) as o) group by doc_id),
s as (select w.doc_id, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             len(ls) as n_lines from w left join p on p.doc_id = w.doc_id),
b as (select *, ({base}) as base_failed from s),
k as (select source, count(*) as host_docs, {counts} from s group by source),
m as (select count(*) as hosts, {sums} from k),
m1 as (select *, {means} from k, m),
m2 as (select *, {variances} from m1),
m3 as (select *, {strengths} from m2),
m4 as (select *, {rates} from m3),
v as (select source, host_docs, greatest({worst}) as worst_rate, not ({bad}) as host_ok from m4)
select b.*, host_docs, worst_rate, not base_failed and host_ok as kept
from b join v on v.source is not distinct from b.source"""


def shingles_cte(source: str, k: int, name: str, id_col: str = "doc_id") -> str:
    """CTEs ``name`` (id, s): distinct k-word shingles; fewer words count as one shingle."""
    gram = "|| ' ' ||".join(f"ws[i + {j}]" for j in range(k))
    return f"""{name}_w as (select {id_col} as id, {WORDS.format(t=LOWER.format(t='text'))} as ws from {source}),
{name} as (select distinct id, {gram} as s from (select id, ws, unnest(range(1, len(ws) - {k - 2})) as i from {name}_w where len(ws) >= {k})
  union select distinct id, array_to_string(ws, ' ') from {name}_w where len(ws) between 1 and {k - 1})"""


def _near_dup() -> str:
    return f"""
with recursive {shingles_cte('documents', 2, 'sh')},
n as (select id, count(*) as n from sh group by id),
-- prefix filter: a pair at 80% shares one of the rarest 20% + 1 shingles of each
f as (select s, count(*) as df from sh group by s),
o as (select sh.id, sh.s, n.n, row_number() over (partition by sh.id order by df, sh.s) as rn from sh join f using (s) join n on n.id = sh.id),
pre as (select id, s, n from o where rn <= n - ceil(n * 0.8) + 1),
cand as (select distinct a.id as x, b.id as y, a.n as nx, b.n as ny from pre a join pre b on a.s = b.s and a.id < b.id
         and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
link as (select x, y from (select x, y, nx, ny, count(*) as c from cand join sh p on p.id = x join sh q on q.id = y and q.s = p.s
         group by all) where 100 * c >= 80 * (nx + ny - c)),
e as (select x, y from link union select y, x from link),
cc(id, c) as (select id, id from n union select e.y, cc.c from cc join e on e.x = cc.id where cc.c < e.y),
m as (select id, min(c) as c from cc group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id,
       coalesce(m.c, d.doc_id) = d.doc_id as kept
from documents d left join n on n.id = d.doc_id left join m on m.id = d.doc_id"""


def contained_sql(k: int = 5, percent: int = 80) -> str:
    return f"""
with {shingles_cte('documents', k, 'ds')}, {shingles_cte('benchmark', k, 'bs', 'item_id')},
q as (select id, count(*) as size from bs group by id)
select ds.id as doc_id, bs.id as item_id, count(*)::bigint as found, any_value(size)::bigint as size, count(*) / any_value(size) as containment
from ds join bs on bs.s = ds.s join q on q.id = bs.id where ds.id is not null
group by 1, 2 having 100 * count(*) >= {percent} * any_value(size)"""


def _mix() -> str:
    weight = "[" + ", ".join(f"{w}.0" for w in mix.WEIGHTS) + "]"
    return f"""
with d as (select row_number() over () as r, doc_id, source, len({WORDS.format(t='text')})::bigint as size from documents),
p0 as (select source, sum(size)::bigint as source_size from d group by source),
p1 as (select *, row_number() over (order by source nulls last) - 1 as rank from p0),
p2 as (select *, {weight}[rank % {len(mix.WEIGHTS)} + 1]::double as weight, source_size * {float(mix.REPEAT)}::double as cap,
              sum(source_size) over () * {mix.SHARE}::double as total from p1),
p3 as (select *, (total - coalesce(sum(cap) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
       from p2 window f as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
p4 as (select *, level * weight >= cap as capped from p3),
p5 as (select *, case when capped then cap else weight * (select arg_min(level, cap / weight) from p4 where not capped
              and cap / weight = (select min(cap / weight) from p4 where not capped)) end as target from p4),
p as (select source, source_size, target, case when source_size > 0 then least({mix.REPEAT}, floor(target / source_size)) else 0 end as passes from p5),
b as (select r, d.source, d.doc_id, b.block, least({mix.BLOCK}, size - b.block * {mix.BLOCK})::bigint as words,
             md5('{mix.SEED}-draw:' || coalesce(doc_id::varchar, 'null') || ':' || b.block) as key
      from d, unnest(range(0, ceil(size / {float(mix.BLOCK)})::bigint)) as b(block)),
k as (select source, key, sum(words) as w from b group by source, key),
c as (select k.source, key, sum(w) over (partition by k.source order by key) as upto, w, target - passes * source_size as rest
      from k join p on p.source is not distinct from k.source),
x as (select source, key from c where rest > 0 and upto - w / 2 <= rest),
t as (select r, sum(words * (passes + case when x.key is null then 0 else 1 end))::bigint as taken
      from b join p on p.source is not distinct from b.source left join x on x.source is not distinct from b.source and x.key = b.key
      group by r)
select d.doc_id, d.source, size, source_size, target, coalesce(taken, 0)::bigint as taken
from d join p on p.source is not distinct from d.source left join t on t.r = d.r"""


def _lines() -> str:
    return rf"""
with d as (select row_number() over () as r, doc_id, source, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, source, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
b as (select r, source, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') as w,
             regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as bare from l),
h as (select source, count(*) as host_pages from d group by source),
f as (select b.source, bare, count(distinct r) as pages from b where w group by 1, 2),
x as (select f.source, bare from f join h on h.source is not distinct from f.source
      where pages >= {lines.MIN_PAGES} and pages > {lines.RATIO}::double * host_pages),
k as (select b.r, b.i, b.line, x.bare is not null as gone from b left join x on b.w and x.bare = b.bare and x.source is not distinct from b.source),
t as (select r, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text, count(*) as n_lines,
             count(*) filter (gone) as n_dropped from k group by r)
select doc_id, t.text, n_lines, n_dropped from d join t using (r)"""


def _lm() -> str:
    p = f"(c + {lm.ADD}::double) / (n + {lm.ADD}::double * (v + 1))"
    return f"""
with crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
             lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as r, doc_id, xor(list_reduce(list_concat([4294967295::bigint],
             list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: case when x = '' then null else ord(x)::bigint end)),
             lambda a, x: case when x is null then a else xor(a >> 8, t[(xor(a, x) & 255) + 1]) end), 4294967295) % 10 = 0 as held_out,
             list_concat({WORDS.format(t=LOWER.format(t='text'))}, [' end']) as ws from documents, crc),
k as (select r, held_out, unnest(ws) as w, unnest(list_concat([' start'], ws[:-2])) as h from d),
u as (select w, count(*) as c from k where not held_out group by w),
s as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from u),
b as (select h, w, count(*) as c from k where not held_out group by h, w),
hs as (select h, sum(c) as c from b group by h),
q as (select k.r, coalesce(u.c, 0) as c, n, v, coalesce(b.c, 0) as cb, hs.c as ch
      from k join s on true left join u on u.w = k.w left join b on b.h = k.h and b.w = k.w left join hs on hs.h = k.h),
z as (select r, c, n, {p} as p, cb, ch from q)
select doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score from d join (
  select r, count(*) as n_tokens, count(*) filter (c > 0) as n_known, any_value(n) as train_tokens, sum(log10(p)) as base_score,
         sum(log10(case when ch > 0 then {lm.FAIL}::double * p + (1 - {lm.FAIL}::double) * cb / ch else p end)) as score from z group by r) using (r)"""


def _licenses() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"
    low = LOWER.format(t="x")
    keys = "[" + ", ".join(map(quoted, licenses.KNOWN)) + "]"
    ids = "[" + ", ".join(map(quoted, licenses.KNOWN.values())) + "]"

    def known(text: str) -> str:
        return rf"""list_transform(list_filter(list_transform(string_split(regexp_replace({text}, '{licenses._BREAK}', '\1' || chr(10), 'g'), chr(10)),
          lambda x: coalesce(list_position({keys}, regexp_replace(regexp_replace({low}, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')), 0)),
          lambda x: x > 0), lambda x: {ids}[x])"""

    def matched(column: str) -> str:
        joined = f"list_aggregate(list_transform({column}, lambda x: ',' || x || ','), 'string_agg', '')"
        for licence, sequence in licenses.RULES:
            joined = f"replace({joined}, '{''.join(f',{i},' for i in sequence)}', ',={licence},')"
        return f"list_filter(string_split(coalesce({joined}, ''), ','), lambda x: x <> '')"

    blank = licenses._BLANK_LINE
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
h as (select *, regexp_matches(t, '(?i){"|".join(licenses.ANCHORS)}') as held from d),
k as (select r, {known('t')} as a, {known(f"replace(replace(regexp_replace(t, '{blank}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10))")} as b
      from h where held),
c as (select *, case when len(b) > len(a) then b else a end as ids from k),
m as (select r, len(ids) as n_known, {matched('a')} as ma, {matched('b')} as mb, {matched('ids')} as mc from c)
select doc_id, coalesce(n_known, 0)::bigint as n_known,
       coalesce(replace(list_aggregate(list_sort(list_distinct(list_filter(list_concat(ma, mb), lambda x: starts_with(x, '=')))), 'string_agg', ','), '=', ''), '') as licenses,
       coalesce(len(list_filter(mc, lambda x: not starts_with(x, '='))), 0)::bigint as n_unmatched
from d left join m using (r)"""


def _urls() -> str:
    wide = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
    rules = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
                     for h, p, _ in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1])))
    verdicts = " ".join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in urls.RULES)
    out = rf"""
with s as (select row_number() over () as r, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
p as (select r, page_id, {LOWER.format(t="regexp_extract(rest, '^[^/?#]*', 0)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
o as (select host, case when toxic = 1 or quality = 0 then 1 else 0 end as bad from p join labels on doc_id = page_id
      where toxic is not null or quality is not null),
c as (select host, count(*) as n, sum(bad) as k from o group by host),
two as (select host, coalesce(n, 0) as n, coalesce(k, 0) as k, string_split(host, '.') as l, array_to_string(l[-2:], '.') as t
        from (select distinct host from p) left join c using (host)),
t0 as (select host, n, k, case when t in ({wide}) then t else l[-1] end as suffix,
              case when t in ({wide}) then array_to_string(l[-3:], '.') else t end as domain from two),
g as (select coalesce(sum(k) / nullif(sum(n), 0), 0)::double as mean from t0)"""
    prior = "mean"
    for i, level in enumerate(urls.LEVELS):
        out += f""",
a{i} as (select {level}, sum(n) as ln, sum(k) as lk from t0 group by {level}),
v{i} as (select mean, coalesce(var_samp(lk / ln), 0) - coalesce(avg(mean * (1 - mean) / ln), 0) as between_ from a{i}, g where ln > 0 group by mean),
w{i} as (select coalesce(max(case when between_ > 0 then greatest(mean * (1 - mean) / between_ - 1, 1.0) else {urls.FLAT_STRENGTH} end), {urls.FLAT_STRENGTH})::double as st{i} from v{i})"""
        if level != "host":
            source = "t0, g" if i == 0 else f"t{i}"
            out += f""",
t{i + 1} as (select x.*, (lk - k + {prior} * st{i}) / (ln - n + st{i}) as p_{level} from (select * from {source}) x join a{i} using ({level}), w{i})"""
            prior = f"p_{level}"
    return out + f""",
ab as (select host, n, k, k + {prior} * st2 as a, n - k + (1 - {prior}) * st2 as b from t2, w2),
rep as (select host, n as labelled, k as bad_labelled, a / (a + b) as rate,
               a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab),
fit as (select *, case {rules} end as rule from p)
select page_id, host, path, rule, case {verdicts} when bound > (select mean from g) then 'block' else 'allow' end as verdict,
       labelled::bigint as labelled, bad_labelled::bigint as bad_labelled, rate, bound from fit join rep using (host)"""


#: ``crc32_of(x)``: unsigned CRC-32 of an ASCII string, through a table ``t`` of 256 entries.
CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
             lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def crc32_of(x: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({x}, ''), lambda x: ord(x)::bigint)),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"""


def _manifest() -> str:
    def leaf(n_chars: str) -> str:
        values = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": n_chars, "text": "text"}
        fields = [f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')" for v in values.values()]
        return f"sha256({' || '.join(fields)})"

    def tree(name: str, source: str, group: str) -> str:
        """CTEs ``name`` (grp, level, pos, n, h): all levels, and ``name``_up (grp, leaf, level, h, side): every leaf's siblings."""
        return f"""
{name}(grp, level, pos, n, h) as (select {group}, 0, pos, n, h from {source}
  union all select grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from {name} where n > 1
  group by grp, level, pos // 2, n),
{name}_up as (select l.grp, l.pos as leaf, x.level, s.h, case when s.pos < (l.pos >> x.level) then 'l' when s.pos is not null then 'r' end as side
  from (select grp, pos from {name} where level = 0) l
  join (select distinct grp, level from {name} where n > 1) x on x.grp = l.grp
  left join {name} s on s.grp = l.grp and s.level = x.level and s.pos = xor(l.pos >> x.level, 1))"""

    return f"""
with recursive {CRC_TABLE},
d as (select row_number() over () as r, doc_id, coalesce('1' || lang, '') as grp, {leaf('n_chars')} as h,
             case when coalesce({crc32_of('doc_id::varchar')} % 7 = 0, false) then {leaf('n_chars::hugeint + 1')} else {leaf('n_chars')} end as th
      from documents, crc),
p as (select *, row_number() over (partition by grp order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by grp) as n from d),
{tree('t', 'p', 'grp')},
sub as (select grp, h, row_number() over (order by grp) - 1 as pos, count(*) over () as n from t where n = 1),
{tree('u', 'sub', "''")},
path as (select p.r, level as step, t_up.h, side from p join t_up on t_up.grp = p.grp and t_up.leaf = p.pos
  union all select p.r, 1000 + level, u_up.h, side from p join sub on sub.grp = p.grp join u_up on u_up.leaf = sub.pos),
steps as (select r, list(coalesce(h, '') order by step) as hs, list(coalesce(side, '') order by step) as sides from path group by r),
fold(r, i, h) as (select r, 0, th from p
  union all select fold.r, i + 1, sha256(case when sides[i + 1] = 'l' then hs[i + 1] || h else h || hs[i + 1] end)
  from fold join steps on steps.r = fold.r where i < len(hs)),
top as (select r, arg_max(h, i) as folded_root from fold group by r)
select p.doc_id, p.h as leaf, sub.h as subroot, (select h from u where n = 1) as root,
       sha256(coalesce(array_to_string(hs, ''), '')) as proof_sha256, folded_root, folded_root = (select h from u where n = 1) as verified
from p join sub on sub.grp = p.grp join top on top.r = p.r left join steps on steps.r = p.r"""


def _exact() -> str:
    return r"""
with d as (select row_number() over () as r, doc_id, length(coalesce(text, '')) as points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
g as (select *, count(*) over (partition by text_sha256) as group_size,
             first_value(doc_id) over w as keep_id, first_value(r) over w as keep_r
      from d window w as (partition by text_sha256 order by points desc, doc_id nulls last, r))
select doc_id, keep_id, group_size, r = keep_r as kept, text_sha256 from g"""


SQL = {
    "op1_decontaminate": contained_sql(),
    "op3_line_dedup": _lines(),
    "op4_mix_sources": _mix(),
    "op5_lm_scores": _lm(),
    "op6_quality_rules": _quality(),
    "op7_licenses": _licenses(),
    "op8_near_dup": _near_dup(),
    "op9_url_filter": _urls(),
    "op12_merkle_manifest": _manifest(),
    "op13_exact_dedup": _exact(),
}
