"""The same results in SQL, built from the tables by other means than the operators use."""

from __future__ import annotations

NL = "chr(10)"


def _q(text: str) -> str:
    """A SQL string literal, newlines spelled out."""
    return "(" + "||chr(10)||".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


# Documents with their lines, the cleaned lines and the method bodies of v_sources.
_METHODS = f"""
v_lines as (
  select doc_id, source, lang, string_split(text, chr(10)) as ls from documents),
v_bodies as (
  select doc_id, source, lang, list_transform(
    list_transform(ls, lambda l: regexp_replace(l, '[^A-Za-z0-9 ]', '', 'g')),
    lambda s, i: case (i-1)%3
      when 0 then {_q('[TestCase(new[] { 1, 2 }), Obsolete("use M{")]')}||chr(10)||'        public void M'||(i-1)||'(string s, int n = 0)'||chr(10)||'        {{'||chr(10)
        ||'            // }} not a brace {{{{'||chr(10)||'            if (n > 0) {{ Log($"{{names["{{"]}}", "'||s||' {{"); }}'||chr(10)||'        }}'
      when 1 then 'internal static Dictionary<string, List<Dictionary<string, List<int>>>> M'||(i-1)||'<T>(T a) => Make(a, "'||s||'");'
      else 'protected abstract (int, (int, (int, string)))[] M'||(i-1)||'();' end) as bodies
  from v_lines),
v_cs as (
  select doc_id, bodies,
    'using System;'||chr(10)||'HASH#region R'||chr(10)||'namespace Corpus.'||source||chr(10)||'{{'||chr(10)||'    // holds {{ one class'||chr(10)
      ||'    [Serializable]'||chr(10)||'    public class Doc'||doc_id||' : Base<'||lang||'>'||chr(10)||'    {{'||chr(10)
      ||'        private const string Brace = "}}{{ \\"{{";'||chr(10)||'        internal int X {{ get; set; }}'||chr(10)||chr(10)
      ||'        public Doc'||doc_id||'(int x)'||chr(10)||'        {{'||chr(10)||'            if (x > 0) {{ X = x; }}'||chr(10)||'        }}'||chr(10) as head,
    list_transform(bodies, lambda b, i: chr(10)||'        /// <summary>'||(i-1)||'</summary>'||chr(10)||'        ') as leads,
    chr(10)||'        struct Pair'||chr(10)||'        {{'||chr(10)||'            public int Sum() => 1;'||chr(10)||'        }}'||chr(10)
      ||'    }}'||chr(10)||'}}'||chr(10)||'HASH#endregion' as tail,
    '/corpus/'||case doc_id%7 when 0 then 'Library' when 1 then 'LibraryCache' else 'Assets' end||'/'
      ||upper(source[1])||source[2:]||'/MyDoc'||doc_id||'Source_file'||case doc_id%11 when 0 then '.txt' when 1 then '' else '.cs' end as path
  from v_bodies),
v_text as (
  select doc_id, path, replace(src, 'HASH#', '#') as raw, replace(src, 'HASH#', '// #')||chr(10) as text,
    replace(bare, 'HASH#', '// #')||chr(10)||chr(10) as skeleton, list_append(bodies, 'public int Sum() => 1;') as units
  from (select *,
    head||list_aggregate(list_transform(list_zip(leads, bodies), lambda z: z[1]||z[2]||chr(10)), 'string_agg', '')||tail as src,
    head||list_aggregate(list_transform(leads, lambda z: z||chr(10)), 'string_agg', '')||tail as bare from v_cs))
"""

_REPLIES = """
v_replies as (
  select doc_id, case doc_id%5
    when 0 then '```cs'||chr(10)||text||chr(10)||'```'
    when 1 then 'Sure:'||chr(10)||'```'||chr(10)||text||chr(10)||'```'||chr(10)||'bye'||chr(10)||'```cpp'||chr(10)||source||chr(10)||'```'
    when 2 then text
    when 3 then '```'||chr(10)||text
    else '// A.h'||chr(10)||text||chr(10)||'```'||chr(10)||'  // A.cpp'||chr(10)||source||chr(10) end as reply from documents)
"""


def _pairs(name="v_pairs", asked="user", answered="assistant"):
    return f"""
{name} as (
  select u.conv_id, u.turn, u.text as source, a.text as target,
    row_number() over (order by u.conv_id, u.turn) as id
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = '{asked}' and a.role = '{answered}')
"""


def _runs(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[ \\t\\n\\r]+|[0-9A-Za-z]+|[^ \\t\\n\\r0-9A-Za-z]+'))"


def _packed(units: str, limit: int, size: str = "length(w.cur) + 2 + length(u.text)") -> str:
    """Greedy packing of ``units(doc_id, unit_ix, text)`` as a walk from unit to unit."""
    return f"""
walk as (
  select distinct doc_id, 0::bigint as pos, ''::varchar as cur, null::varchar as sent, 0::bigint as batch_ix from {units}
  union all
  select w.doc_id, w.pos + 1,
    case when {size} < {limit} then w.cur||chr(10)||chr(10)||u.text else u.text end,
    case when {size} < {limit} then null else w.cur end,
    case when {size} < {limit} then w.batch_ix else w.batch_ix + 1 end
  from walk w join {units} u on u.doc_id = w.doc_id and u.unit_ix = w.pos),
packed as (
  select doc_id, batch_ix - 1 as batch_ix, sent as text from walk where sent is not null
  union all
  select doc_id, batch_ix, cur from (select *, row_number() over (partition by doc_id order by pos desc) as back from walk)
  where back = 1 and length(cur) > 0)
"""


_WS = "||".join(
    f"chr({c})"
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_PIECES = """
cut as (select * from v_text where length(text) >= 2000),
cut_units as (select doc_id, unnest(units) as text, (generate_subscripts(units, 1) - 1)::bigint as unit_ix from cut),
""" + _packed("cut_units", 2000) + """,
pieces as (
  select doc_id, 'full' as kind, 0 as piece_ix, text as code from v_text where length(text) < 2000
  union all select doc_id, 'class_only', 0, skeleton from cut
  union all select doc_id, 'methods_only', batch_ix::int + 1, text from packed)
"""

_TRIGRAMS = """
chars as (
  select o, doc_id, unicode(ch) as c, pos from (
    select 'd' as o, doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as pos from documents
    union all
    select 'p', id, unnest(string_split(source, '')), generate_subscripts(string_split(source, ''), 1) from v_pairs)),
grams as (
  select o, doc_id, (961 * c + 31 * lead(c, 1) over w + lead(c, 2) over w) % 64 as bucket, lead(c, 2) over w as last
  from chars window w as (partition by o, doc_id order by pos)),
counts as (
  select o, doc_id, bucket, count(*)::double as n from grams where last is not null group by all),
sized as (
  select o, doc_id, bucket, n / sqrt(sum(n * n) over (partition by o, doc_id)) as w from counts),
owners as (select 'd' as o, doc_id from documents union all select 'p', id from v_pairs),
dense as (
  select x.o, x.doc_id, b.bucket, coalesce(s.w, 0.0) as w
  from owners x cross join (select unnest(range(64)) as bucket) b
  left join sized s on s.o = x.o and s.doc_id = x.doc_id and s.bucket = b.bucket)
"""

_KNN = """
  select query_id, rank::int as rank, known_id, round(d, 6) as distance from (
    select query_id, known_id, d, row_number() over (partition by query_id order by round(d, 9), known_id) as rank from (
      select a.vec_id as query_id, b.vec_id as known_id,
        list_sum(list_transform(list_zip(a.embedding, b.embedding),
          lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as d
      from embeddings a cross join embeddings b)) where rank <= 5
"""

_HISTORY = f"""
history as (
  select conv_id, turn, 0 as ix, 'user' as role,
    replace(replace({_q("Known:" + chr(10) + "${SOURCE}" + chr(10) + "becomes" + chr(10) + "${TARGET}")}, '${{SOURCE}}', source), '${{TARGET}}', target) as content from v_pairs
  union all select conv_id, turn, 1, 'assistant', 'Noted.' from v_pairs)
"""

_TOXIC = """
asked as (
  select d.doc_id, d.source, d.text, coalesce(l.toxic, 0) = 1 as refused from documents d
  left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id)
"""


def _filled(template: str, code: str) -> str:
    return f"replace({_q(template)}, '${{CODE}}', {code})"


def _with(*ctes: str, select: str) -> str:
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n" + select


_SNAKE_NAME = "lower(regexp_replace({}, '([a-z])([A-Z])', '\\1_\\2', 'g'))"
_CAMEL_NAME = (
    "(string_split({0}, '_')[1] || coalesce(list_aggregate(list_transform(string_split({0}, '_')[2:], "
    "lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ''), ''))"
)
_FILE = "regexp_extract(path, '[^/]*$')"
_STEM = f"regexp_replace({_FILE}, '\\.(cs|txt)$', '')"
_DIR = "regexp_extract(path, '^/corpus/(.*)/[^/]*$', 1)"

_HEADER_WALK = f"""
reply_lines as (
  select doc_id, line, pos, ltrim(line, {_WS}) as head, rtrim(line, {_WS}) as rest from (
    select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (
      select doc_id, string_split_regex(regexp_replace(reply, '\\n$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as ls from v_replies))),
tagged as (
  select *, case when starts_with(head, '```') then 'fence'
    when starts_with(head, '//') and ends_with(rest, '.h') then 'h'
    when starts_with(head, '//') and ends_with(rest, '.cpp') then 'i' else 'text' end as tag from reply_lines),
states as (
  select doc_id, 0::bigint as pos, ''::varchar as part, false as named, ''::varchar as header, ''::varchar as body from v_replies
  union all
  select s.doc_id, t.pos,
    case when t.tag = 'fence' and s.named then s.part
         when t.tag = 'fence' then case when s.part <> '' then '' when s.header <> '' then 'i' else 'h' end
         when t.tag in ('h', 'i') then t.tag else s.part end,
    s.named or t.tag in ('h', 'i'),
    case when t.tag = 'text' and s.part = 'h' then s.header||t.line||chr(10) else s.header end,
    case when t.tag = 'text' and s.part = 'i' then s.body||t.line||chr(10) else s.body end
  from states s join tagged t on t.doc_id = s.doc_id and t.pos = s.pos + 1),
ended as (
  select * from (select *, row_number() over (partition by doc_id order by pos desc) as back from states) where back = 1)
"""

SQL: dict[str, str] = {
    "corpus_scan": """
select 'Assets/'||source||case when doc_id%13=0 then '/.cache/' else '/' end||'Doc.v'||doc_id||case when doc_id%11=0 then '' else '.cs' end as rel_path,
  case when doc_id%11=0 then '.v'||doc_id else '.cs' end as ext,
  case when doc_id%50=0 then 0 else strlen(text) end as length from documents""",
    "corpus_scan_pruned": """
select case when doc_id%7=2 then 'Assets/Library/' else 'Assets/' end||source||'/'||doc_id||'.cs' as rel_path, strlen(text) as length
from documents where doc_id%7 not in (0, 1)""",
    "file_sink_committed": """
select source||'/'||doc_id||'.h' as rel_path, strlen(source) as length from documents where doc_id%17<>0
union all select source||'/'||doc_id||'.cpp', strlen(text) from documents where doc_id%17<>0
union all select doc_id||' failed', 0 from documents where doc_id%17=0""",
    "layout_check": """
select name from (values ('en'), ('fr'), ('xx')) t(name) where name not in (select lang from documents)""",
    "read_text_normalized": """
select doc_id, case when doc_id%50=0 or doc_id%17=0 then 'failed' else 'ok' end as status,
  case when doc_id%50=0 then 'file is empty' when doc_id%17=0 then 'file is not valid UTF-8' end as error,
  case when doc_id%50=0 or doc_id%17=0 then null else text end as text from documents""",
    "known_pairs_source": _with(_pairs(), select="select source, target from v_pairs"),
    "known_pairs_upsert": _with(
        _pairs(), _pairs("v_back", "assistant", "user"),
        select="""
select coalesce(b.id, p.id)::varchar as id, coalesce(b.source, p.source) as source, coalesce(b.target, p.target) as target
from v_pairs p full join v_back b on b.id = p.id""",
    ),
    "known_pairs_merged": _with(
        _pairs(), _pairs("v_back", "assistant", "user"),
        select="""
select coalesce(b.id, p.id)::varchar as id, coalesce(c.source, b.source, p.source) as source, coalesce(c.target||'!', b.target, p.target) as target
from v_pairs p full join v_back b on b.id = p.id left join v_pairs c on c.id = p.id and c.id % 50 = 0""",
    ),
    "file_sink": """
select doc_id, source||'/'||doc_id||'.txt' as rel_path, strlen(text) as length, text from documents""",
    "ignore_locations": _with(_METHODS, select="select doc_id, path from v_text where path not like '/corpus/Library%'"),
    "route_by_extension": _with(
        _METHODS,
        select="""
select doc_id, path, case when path like '%.cs' then 'CSharpCompilationUnitToSingleFileWithLLM'
  else 'CSharpCompilationUnitToInterfaceImplementationWithLLM' end as strategy
from v_text where path like '%.cs' or path like '%.txt'""",
    ),
    "destination_path": _with(
        _METHODS,
        select=f"""
select doc_id, '/out/'||lower({_DIR})||'/'||{_SNAKE_NAME.format(_STEM)}||'.gd' as snake,
  '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.h' as camel,
  '/out/'||{_DIR}||'/'||{_STEM}||'.cs' as plain from v_text""",
    ),
    "destination_collisions": """
with named as (
  select doc_id, '/corpus/Assets/'||case when doc_id%2=0 then 'FooBar' else 'foo_bar' end||(doc_id//2)||'.'||source as path,
    '/out/Assets/foo_bar'||(doc_id//2)||'.gd' as dest_path from documents)
select doc_id, path, dest_path, path = min(path) over (partition by dest_path) as wins from named""",
    "camel_to_snake": f"""
select p_partkey, {_SNAKE_NAME.format('name')} as name
from (select p_partkey, 'partItem'||replace(p_name, ' ', '_')||'Brand'||p_size as name from part)""",
    "snake_to_camel": f"""
select p_partkey, {_CAMEL_NAME.format('name')} as name
from (select p_partkey, 'partItem'||replace(p_name, ' ', '_')||'Brand'||p_size as name from part)""",
    "macros_to_comments": _with(_METHODS, select="select doc_id, text from v_text"),
    "convert_indent": """
with t as (
  select doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda l, i:
    case when (i-1)%3=0 then replace(l, ' ', '    ') else replace(l, ', ', ','||chr(9)) end), 'string_agg', chr(10)) as text from documents)
select doc_id, replace(text, chr(9), '    ') as spaces, replace(text, '    ', chr(9)) as tabs,
  replace(replace(text, chr(9), '    '), '    ', chr(9)) as both from t""",
    "extract_first_code": _with(
        _REPLIES,
        select=f"""
select doc_id, {_strip('''case when strpos(reply, '```') > 0 and strpos(substr(reply, strpos(reply, '```')), chr(10)) > 0
  and strpos(rest, '```') > 0 then substr(rest, 1, strpos(rest, '```') - 1) else reply end''')} as code
from (select *, substr(reply, strpos(reply, '```') + strpos(substr(reply, strpos(reply, '```')), chr(10)) - 1) as rest from v_replies)""",
    ),
    "extract_header_impl": _with(
        _REPLIES, _HEADER_WALK,
        select=f"""
select e.doc_id, {_strip("case when header = '' and body = '' then reply else header end")} as header,
  {_strip("case when header = '' and body = '' then 'SEE HEADER FOR FULL RESPONSE' else body end")} as implementation
from ended e join v_replies r on r.doc_id = e.doc_id""",
    ),
    "token_count": "select doc_id, length(text)::bigint as n_tokens from documents",
    "token_count_words": f"""
select doc_id, {_runs("text")}::bigint as n_tokens, {_runs("chr(10)||chr(10)||text")}::bigint as n_after_break from documents""",
    "budget_split": """
select doc_id, length(text)::bigint as n_tokens, case when length(text) < 2000 then 'whole' else 'segmented' end as way from documents""",
    "segment_units": _with(
        _METHODS,
        select="select doc_id, (generate_subscripts(units, 1) - 1)::int as unit_ix, unnest(units) as text from v_text",
    ),
    "segment_skeleton": _with(_METHODS, select="select doc_id, skeleton from v_text"),
    "request_union": _with(_METHODS, _PIECES, select="select doc_id, kind, piece_ix, code from pieces"),
    "render_prompt": f"""
select doc_id, kind, case kind when 'full' then {_filled("Translate:" + chr(10) + "${CODE}", "text")}
  when 'class_only' then {_filled("Class:" + chr(10) + "${CODE}" + chr(10) + "${METHODS}", "text")}
  when 'methods_only' then {_filled("Methods:" + chr(10) + "${CODE}", "text")} end as "user",
  case when kind = 'other' then 'prompt ''other'' is not defined' end as error
from documents cross join (values ('full'), ('class_only'), ('methods_only'), ('other')) k(kind)""",
    "fewshot_history": _with(_pairs(), _HISTORY, select="select conv_id, turn, ix as msg_ix, role, content from history"),
    "assemble_messages": _with(
        _pairs(), _HISTORY,
        select="""
select conv_id, turn, ix + case when conv_id%2=0 then 1 else 0 end as msg_ix, role, content from (
  select * from history union all select conv_id, turn, 2, 'user', source from v_pairs)
union all select conv_id, turn, 0, 'system', 'Answer with code only.' from v_pairs where conv_id%2=0""",
    ),
    "flatten_messages": _with(
        _pairs(),
        select=f"""
select conv_id, turn, case when conv_id%2=0 then '[INST]Remember these rules:'||chr(10)||'Answer with code only.'||chr(10)||'[/INST]'
    ||chr(10)||'Certainly, I will remember and follow these rules.'||chr(10) else '' end
  ||'[INST]'||chr(10)||'Known:'||chr(10)||source||chr(10)||'becomes'||chr(10)||target||chr(10)||'[/INST]'
  ||chr(10)||'Noted.'||chr(10)||'[INST]'||chr(10)||source||chr(10)||'[/INST]' as prompt from v_pairs""",
    ),
    "embed_text": _with(
        _pairs(), _TRIGRAMS,
        select="select doc_id, bucket::int as bucket, round(w, 9) as weight from dense where o = 'd'",
    ),
    "embed_text_stored": _with(
        _pairs(), _TRIGRAMS,
        select="select doc_id, bucket::int as bucket, round(w, 9) as weight, 0::bigint as embedded from dense where o = 'd'",
    ),
    "knn_exact": _KNN,
    "knn_in_blocks": _KNN,
    "rag_requests": _with(
        _pairs(), _TRIGRAMS,
        """
vectors as (select o, doc_id, list(w order by bucket) as v from dense group by o, doc_id),
near as (
  select doc_id, id, rank from (
    select doc_id, id, row_number() over (partition by doc_id order by round(d, 9), id) as rank from (
      select a.doc_id, b.doc_id as id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
      from vectors a cross join vectors b where a.o = 'd' and b.o = 'p')) where rank <= 2),
examples as (select n.doc_id, n.rank, p.source, p.target from near n join v_pairs p on p.id = n.id)""",
        select="""
select doc_id, 0 as msg_ix, 'system' as role, 'Answer with code only.' as content from documents
union all select doc_id, 2 * rank::int - 1, 'user', 'Known:'||chr(10)||source||chr(10)||'becomes'||chr(10)||target from examples
union all select doc_id, 2 * rank::int, 'assistant', 'Noted.' from examples
union all select d.doc_id, 1 + 2 * (select count(*) from examples e where e.doc_id = d.doc_id)::int, 'user',
  'Translate:'||chr(10)||text from documents d""",
    ),
    "batch_infer": "select doc_id, text as response, null::varchar as error from documents",
    "batch_infer_errors": _with(
        _TOXIC,
        select="""
select doc_id, case when refused then null else 'Re: '||text end as response,
  case when refused then 'query failed: refused' end as error from asked""",
    ),
    "reply_validity": """
select doc_id, case when doc_id%13=0 then 'provider returned a malformed reply' end as error from documents""",
    "outcome_report": _with(
        _TOXIC, select="select source, case when refused then 'failed' else 'ok' end as status, count(*) as n from asked group by 1, 2"
    ),
    "splice_methods": """
select doc_id, 'class '||source||case doc_id%3 when 0 then ' { '||text||' }' when 1 then ' { '||text||' | '||text||' }'
  else ' { }'||text end as text from documents""",
}

_DOC_UNITS = """
units as (
  select doc_id, unnest(string_split(text, chr(10))) as text,
    (generate_subscripts(string_split(text, chr(10)), 1) - 1)::bigint as unit_ix from documents)
"""

SQL["pack_units"] = _with(
    _DOC_UNITS, _packed("units", 1000), select="select doc_id, batch_ix::int as batch_ix, text from packed"
)
SQL["rag_requests_large"] = SQL["rag_requests"]
SQL["pack_units_counted"] = _with(
    _DOC_UNITS, _packed("units", 200, _runs("w.cur||chr(10)||chr(10)||u.text")),
    select="select doc_id, batch_ix::int as batch_ix, text from packed",
)
SQL["pack_units_nonempty"] = _with(
    _DOC_UNITS, _packed("units", 1000),
    select="""
select doc_id, (row_number() over (partition by doc_id order by batch_ix) - 1)::int as batch_ix, text from packed where text <> ''""",
)
SQL["concat_replies"] = _with(
    _DOC_UNITS, _packed("units", 1000),
    select="""
select doc_id, string_agg(chr(10)||chr(10)||text, '' order by batch_ix) as methods from packed group by doc_id""",
)

# The whole jobs, with the identity provider: replies are the prompts, stripped.
SQL["migrate_single_file"] = _with(
    _METHODS, _PIECES,
    f"""
replies as (
  select doc_id, kind, piece_ix, {_strip('''case kind when 'full' then 'Translate:'||chr(10)||code
    when 'class_only' then 'Class:'||chr(10)||code||chr(10)||'${METHODS}' else 'Methods:'||chr(10)||code end''')} as code from pieces),
methods as (
  select doc_id, string_agg(chr(10)||chr(10)||code, '' order by piece_ix) as m from replies where kind = 'methods_only' group by doc_id),
whole as (
  select r.doc_id, case when kind = 'full' then code else replace(code, '${{METHODS}}', coalesce(m, '')) end as content
  from replies r left join methods m on m.doc_id = r.doc_id where kind <> 'methods_only')""",
    select=f"""
select path, 'ok' as status, null::varchar as error,
  '/out/'||lower({_DIR})||'/'||{_SNAKE_NAME.format(_STEM)}||'.gd' as dest_path, replace(content, '    ', chr(9)) as content
from v_text t join whole w on w.doc_id = t.doc_id""",
)
SQL["migrate_two_files"] = _with(
    _METHODS, _PIECES,
    f"""
replies as (
  select doc_id, kind, piece_ix, {_strip('''case when kind = 'class_only' then code||chr(10)||'${METHODS}' else code end''')} as h,
    {_strip("'// body'||chr(10)||code")} as i from pieces),
methods as (
  select doc_id, string_agg(chr(10)||chr(10)||h, '' order by piece_ix) as mh, string_agg(chr(10)||chr(10)||i, '' order by piece_ix) as mi
  from replies where kind = 'methods_only' group by doc_id),
whole as (
  select r.doc_id, case when kind = 'full' then h else replace(h, '${{METHODS}}', coalesce(mh, '')) end as header,
    case when kind = 'full' then i else i||chr(10)||chr(10)||coalesce(mi, '') end as body
  from replies r left join methods m on m.doc_id = r.doc_id where kind <> 'methods_only')""",
    select=f"""
select path, 'ok' as status, null::varchar as error, '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.h' as dest_path, header as content
from v_text t join whole w on w.doc_id = t.doc_id
union all
select path, 'ok', null, '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.cpp', body
from v_text t join whole w on w.doc_id = t.doc_id""",
)

SQL["migrate_mixed"] = _with(
    _METHODS, _PIECES,
    f"""
replies as (
  select doc_id, kind, piece_ix, {_strip('''case when kind = 'class_only' then code||chr(10)||'${METHODS}' else code end''')} as h,
    {_strip("'// body'||chr(10)||code")} as i,
    {_strip(''''// A.h'||chr(10)||code||chr(10)||case when kind = 'class_only' then '${METHODS}'||chr(10) else '' end||'// A.cpp'||chr(10)||'// body'||chr(10)||code''')} as s from pieces),
methods as (
  select doc_id, string_agg(chr(10)||chr(10)||h, '' order by piece_ix) as mh, string_agg(chr(10)||chr(10)||i, '' order by piece_ix) as mi,
    string_agg(chr(10)||chr(10)||s, '' order by piece_ix) as ms from replies where kind = 'methods_only' group by doc_id),
whole as (
  select r.doc_id, case when kind = 'full' then s else replace(s, '${{METHODS}}', coalesce(ms, '')) end as single,
    case when kind = 'full' then h else replace(h, '${{METHODS}}', coalesce(mh, '')) end as header,
    case when kind = 'full' then i else i||chr(10)||chr(10)||coalesce(mi, '') end as body
  from replies r left join methods m on m.doc_id = r.doc_id where kind <> 'methods_only')""",
    select=f"""
select path, 'ok' as status, null::varchar as error, '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.gd' as dest_path, single as content
from v_text t join whole w on w.doc_id = t.doc_id where t.doc_id%5 <> 4 and t.doc_id%2 = 0
union all
select path, 'ok', null, '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.h', header
from v_text t join whole w on w.doc_id = t.doc_id where t.doc_id%5 <> 4 and t.doc_id%2 = 1
union all
select path, 'ok', null, '/out/'||{_DIR}||'/'||{_CAMEL_NAME.format(_STEM)}||'.cpp', body
from v_text t join whole w on w.doc_id = t.doc_id where t.doc_id%5 <> 4 and t.doc_id%2 = 1
union all
select path, 'failed', 'strategy \'\'Nobody\'\' is not known', null, null from v_text t where t.doc_id%5 = 4""",
)

SQL["migrate_project"] = """
with files as (
  select doc_id, 'Assets/'||case doc_id%10 when 0 then 'FooBar'||(doc_id//10) when 1 then 'foo_bar'||(doc_id//10) else 'Doc'||doc_id end||'.cs' as path,
    'Assets/'||case when doc_id%10 < 2 then 'foo_bar'||(doc_id//10) else 'doc'||doc_id end||'.gd' as dest_path, case when doc_id%13 = 0 then '' else text end as text
  from documents where doc_id%7 <> 0 and doc_id%11 <> 0),
ranked as (select *, row_number() over (partition by dest_path order by path) as place from files),
pairs as (
  select count(*) as n from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
outcome as (
  select *, case when place > 1 then 'another file has the same destination' when text = '' then 'file is empty'
    when length(text)%5 = 0 then 'query failed: no fives' end as error from ranked)
select path, dest_path, case when place > 1 then 'skipped' when error is null then 'ok' else 'failed' end as status, error,
  case when error is null then '// Answer with code only.'||chr(10)||text||chr(10)||'// '||(2 * least(n, 2)) end as content
from outcome, pairs
"""

SQL["batch_infer_resumed"] = "select doc_id, case when doc_id%2 = 0 then 'first: ' else 'second: ' end||text as response, null::varchar as error from documents"
SQL["batch_infer_timeouts"] = """
select doc_id, case when doc_id%97 <> 3 then text end as response, case when doc_id%97 = 3 then 'query timed out after 2 s' end as error from documents"""
