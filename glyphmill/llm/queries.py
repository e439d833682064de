"""The registered queries: each operator, with production parameters, over its whole table; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import alignment, common, decontaminate, fingerprints, hilbert, manifest, mixing, near_dups, preferences, pseudonyms, quality, token_counts, token_files, url_filter
from glyphmill.llm.common import table
from glyphmill.scratch import materialize, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_dir(spark, "token-cache")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "piece_bpe_32k.model", cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), scratch_dir(spark, "planes"), "byte_bpe_50k.json", end_id=2)
    return token_files.read_token_files(files)


@query
def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, "piece_bpe_32k.model", keep=["doc_id", "lang"])


@query
def op4_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="registered query")


URL_RULES = [
    url_filter.Rule("com/", "allow"), url_filter.Rule("example.com/en/", "block"), url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"), url_filter.Rule("net/fr/", "block"),
]


@query
def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a rule decides are the labelled addresses; the trees judge the others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    verdict = url_filter.rule_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)["verdict"]
    labelled = pages.select("url", (verdict == "block").cast("int").alias("block")).filter("block is not null")
    return url_filter.decide(pages, URL_RULES, url_filter.train(labelled))


@query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op6_lsh_forest"] = r"""
with recursive words as (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), starts as (select row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0),
single as materialized (select distinct row, array_to_string(w[i:i + 4], ' ') as shingle from starts),
sizes as (select row, count(*) as size from single group by row),
common as (select a.row as a, b.row as b, count(*) as n from single a join single b using (shingle) where a.row <> b.row group by all),
links as (
    select c.a, c.b from common c join sizes x on x.row = c.a join sizes y on y.row = c.b where 100 * c.n >= 85 * (x.size + y.size - c.n)
), reach as (select row as a, row as b from words union select r.a, l.b from reach r join links l on l.a = r.b),
named as (select r.a, min(d.doc_id) as component_id from reach r join words d on d.row = r.b group by r.a)
select d.doc_id, coalesce(s.size, 0)::bigint as n_shingles, n.component_id, coalesce(d.doc_id = n.component_id, d.doc_id is null and n.component_id is null) as kept
from words d join named n on n.a = d.row left join sizes s on s.row = d.row
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", (F.size("item_ids") + F.col("unnamed_item").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op7_decontamination"] = r"""
with words as (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where text is not null
), windows as (
    select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x
    from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)
), lengths as (select w.row, w.w, l.n from words w, (select distinct n from windows) l where len(w.w) >= l.n),
starts as (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from lengths),
tried as materialized (select row, i, n, array_to_string(w[i:i + n - 1], ' ') as x from starts),
hits as (select t.row, t.i, t.n, h.item from tried t join windows h using (n, x)), covered as (select row, count(distinct spot) as n_hit from (select row, unnest(range(i, i + n)) as spot from hits) group by row),
found as (select row, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct row, item from hits) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (row) left join found using (row)
"""


@query
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last answer; spans are shown as ``start+length``."""
    pairs = preferences.examples(*preferences.with_other_answer(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), " ")
    return pairs.withColumns({c: shown(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


SQL["op8_preferences"] = """
with said as (
    select distinct conv_id as pair_id, coalesce(turn, -4611686018427387904) as turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
), last as (
    select pair_id, max(turn) as until, max_by(text, (turn, text)) as text from said where role = 'assistant' and turn > -4611686018427387904 group by pair_id
), rejected as (
    select s.* from said s left join last l using (pair_id) where l.until is null or s.turn < l.until
    union
    select l.pair_id, l.until, 'assistant', o.text from last l join last o on o.pair_id = xor(l.pair_id, 1)
), both_sides as (select 'chosen' as side, * from said union all select 'rejected', * from rejected),
at_turn as (
    select pair_id, turn, list((role, text) order by role, text) filter (side = 'chosen') as c, list((role, text) order by role, text) filter (side = 'rejected') as r
    from both_sides group by pair_id, turn
), ends as (select pair_id, min(turn) filter (c is distinct from r) as cut from at_turn group by pair_id),
parts as (
    select b.pair_id, case when e.cut is null or b.turn < e.cut then 'prompt' else b.side end as part, b.turn, b.role, b.text
    from both_sides b join ends e using (pair_id) where not (b.side = 'rejected' and (e.cut is null or b.turn < e.cut))
), written as (
    select *, '<|' || role || '|>
' as head, text || '<|end|>
' as body from parts
), placed as (
    select *, coalesce(sum(length(head) + length(body)) over (partition by pair_id, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + length(head) as start
    from written
)
select pair_id, count(distinct turn) filter (part = 'prompt') as n_prompt_turns,
    coalesce(string_agg(head || body, '' order by turn, role, text) filter (part = 'prompt'), '') as prompt,
    coalesce(string_agg(head || body, '' order by turn, role, text) filter (part = 'chosen'), '') as chosen,
    coalesce(string_agg(head || body, '' order by turn, role, text) filter (part = 'rejected'), '') as rejected,
    coalesce(string_agg(start::bigint || '+' || length(body), ' ' order by turn, role, text) filter (part = 'chosen' and role = 'assistant'), '') as chosen_spans,
    coalesce(string_agg(start::bigint || '+' || length(body), ' ' order by turn, role, text) filter (part = 'rejected' and role = 'assistant'), '') as rejected_spans
from placed group by pair_id
"""


@query
def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size, crc = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16, F.crc32(common.text_bytes(F.col("text")))
    # Texts are read for their digest only and not moved.
    rows = hilbert.places(docs.select("doc_id", "source", "lang", size.alias("size"), crc.alias("text_crc32")), values=["source", "lang"], sizes=["size"], shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


@query
def op10_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array("source")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", mixing.pattern_key(sources).alias("key"), sources.alias("sources"), mixing.draw(0, F.col("doc_id"), F.col("text")).alias("draw"), common.word_count(F.col("text")).alias("size")
    )
    sized = materialize(docs, "mix-sizes")
    cuts, targets = mixing.plan(sized, mixing.Weights())
    per_source = targets.select(mixing.pattern_key(F.array("source")).alias("key"), "source_size", "target")
    # Written first: the join then knows that its rows are few.
    given = materialize(cuts.join(per_source, "key"), "mix-cuts")
    taken = (F.col("size") * mixing.copies(F.col("draw"), F.struct("whole", "cut"))).cast("long")
    return sized.join(given, "key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL["op10_min_cost_flow"] = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('0:' || coalesce(doc_id::varchar, 'text ' || md5(coalesce(text, '')))) as draw from documents
), sources as (
    select source, sum(size)::bigint as s, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as w from sized group by source
), poured as (
    select *, (sum(s) over ())::bigint as whole_size, coalesce(sum(2 * s) over (order by s / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
        (sum(w) over (order by s / w::double, source nulls last rows between current row and unbounded following))::bigint as shared
    from sources
), full_ones as (select *, w * (3 * whole_size - 2 * caps) > 4 * s * shared as capped from poured),
targets as (
    select source, s, case when capped then (2 * s)::double
        else (w * (3 * whole_size - 2 * coalesce(sum(2 * s) filter (capped) over (), 0)::bigint))::double / (2 * sum(w) filter (not capped) over ())::double end as target
    from full_ones
), budgets as (
    select *, case when s > 0 then round_even(target, 0)::bigint // s else 0 end as times, case when s > 0 then round_even(target, 0)::bigint % s else 0 end as rest from targets
), peers as (select source, draw, sum(size) as size from sized group by all),
ordered as (
    select source, draw, size, coalesce(sum(size) over (partition by source order by draw rows between unbounded preceding and 1 preceding), 0) as below from peers
)
select d.doc_id, d.size::bigint as size, b.s as source_size, b.target,
    (d.size * (b.times + (2 * o.below + o.size <= 2 * b.rest)::int))::bigint as taken
from sized d join budgets b on d.source is not distinct from b.source join ordered o on o.source is not distinct from d.source and o.draw = d.draw
"""


@query
def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edits(table(spark, sf_dir, "documents"))
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


@query
def op12_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    # Every token that ends a group is linked with the one of the other side that ends there.
    rows = aligned.select("row", F.col("ident").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), digest.alias("groups_sha256"), "pairs", "times")
    return alignment.linked(materialize(rows, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are tampered with: their texts lose their line feeds."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n"), manifest.leaf_of(cut))
    made = manifest.manifest(docs, columns, "doc_id", "source", {"tampered": tampered})
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    shown = made.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op13_merkle_manifest"] = r"""
with recursive given as (
    select doc_id, source, text, [doc_id::varchar, source, lang, n_chars::varchar] as meta,
        list_reduce([4294967295] || [ascii(c)::bigint for c in string_split(doc_id::varchar, '')],
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
    from documents
), hashed as (
    select *, array_to_string([coalesce(strlen(x) || ':' || x, '-') for x in meta], '') as head, xor(crc, 4294967295) % 2 = 0 as touched from given
), leaves as (
    select row_number() over () as row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when coalesce(touched, false) then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
            else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as now
    from hashed
), numbered as (
    select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves
), tree as (
    select tree, 0 as level, place, leaf as digest, count(*) over (partition by tree) as n from numbered
    union all
    select distinct tree, level + 1, place // 3, sha256(string_agg(digest, '' order by place) over (partition by tree, place // 3 rows between unbounded preceding and unbounded following)), (n + 2) // 3
    from tree where n > 1
), subroots as (select tree, digest as subroot from tree where n = 1),
top as (
    select 0 as level, tree as place, subroot as digest, count(*) over () as n from subroots
    union all
    select distinct level + 1, place // 3, sha256(string_agg(digest, '' order by place) over (partition by place // 3 rows between unbounded preceding and unbounded following)), (n + 2) // 3
    from top where n > 1
), runs as (
    select tree, level, place // 3 as run, list(digest order by place) as kids from tree where n > 1 group by all
), top_runs as (
    select level, place // 3 as run, list(digest order by place) as kids from top where n > 1 group by all
), climb as (
    select row, tree, place, place as spot, 0 as level, now as folded, '' as proof from numbered
    union all
    select c.row, c.tree, c.place, c.spot // 3, c.level + 1,
        sha256(array_to_string([case when i = c.spot % 3 + 1 then c.folded else r.kids[i] end for i in range(1, len(r.kids) + 1)], '')),
        c.proof || array_to_string([r.kids[i] for i in range(1, len(r.kids) + 1) if i <> c.spot % 3 + 1], '')
    from climb c join runs r on r.tree = c.tree and r.level = c.level and r.run = c.spot // 3
), arrived as (select * from climb where not exists (from runs r where r.tree = climb.tree and r.level = climb.level)),
upper as (
    select row, tree as spot, 0 as level, folded, proof from arrived
    union all
    select u.row, u.spot // 3, u.level + 1,
        sha256(array_to_string([case when i = u.spot % 3 + 1 then u.folded else r.kids[i] end for i in range(1, len(r.kids) + 1)], '')),
        u.proof || array_to_string([r.kids[i] for i in range(1, len(r.kids) + 1) if i <> u.spot % 3 + 1], '')
    from upper u join top_runs r on r.level = u.level and r.run = u.spot // 3
), done as (select * from upper where not exists (from top_runs r where r.level = upper.level))
select l.doc_id, l.leaf, s.subroot, t.digest as root, sha256(d.proof) as proof_sha256, d.folded as folded_root, d.folded = t.digest as verified
from numbered l join subroots s using (tree) join done d using (row) cross join (select digest from top where n = 1) t
"""
