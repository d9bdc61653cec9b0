"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondlake.llm import (chat, langid, merkle, minmax_hash, mixing, packing, piece_codec, prefix_trie, quality, radix_dedup, secret_ledger, token_order,
                          wrapper_html)
from pondlake.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper_html.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op2_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of ``documents`` as its record reads in the written shards."""
    path = f"{Scratch(spark, 'shards').root}/shards"
    manifest = token_order.materialise(token_order.sequences(_table(spark, sf_dir, "documents")), path, key=20240229)
    read = token_order.read_slots(spark, path).drop("ids", "length")
    return manifest.join(read, "slot").select("doc_id", "piece", "length", "slot", "shard", "byte_offset", "ids_crc32")


@_query
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents")).drop("ids")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_chats(given.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE["op4_chat_format"] = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
         length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(\+?/?INST|\+?SYS|\+?ROLE|TEXT)\]')) as written
  from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
       cast(7 + sum(written + case role when 'system' then 5 when 'user' then 6 when 'assistant' then 7
                              else 12 + length(role) end + case when role = before then 1 else 0 end) as bigint) as formatted_chars
from m group by conv_id"""


@_query
def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    samples = langid.sample(docs, ~F.coalesce(held_out, F.lit(False)))
    out = langid.identify(docs, langid.fit(samples) if samples else None)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_classes(_table(spark, sf_dir, "documents")).drop("text_key")


ORACLE["op6_radix_dedup"] = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (
  select doc_id, t, first_value(doc_id) over w as keep_id, row_number() over w as place,
         count(*) over (partition by t) as group_size
  from n window w as (partition by t order by doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from g"""


@_query
def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["place"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@_query
def op8_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = quality.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[F.col(q)[k].alias(k) for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@_query
def op10_minmax_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_hash.near_components(_table(spark, sf_dir, "documents")).drop("text_key")


ORACLE["op10_minmax_components"] = r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingles
  from w),
one as (select r, len(shingles) as n, unnest(shingles) as shingle from sets),
links as (
  select a.r as a, b.r as b from one a join one b on a.shingle = b.shingle and a.r < b.r
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select r, r from sets union select reach.a, edges.b from reach join edges on edges.a = reach.b),
named as (select reach.a as r, min(sets.doc_id) as component_id from reach join sets on sets.r = reach.b group by reach.a)
select doc_id, cast(len(shingles) as bigint) as n_shingles, component_id, doc_id is not distinct from component_id as kept
from sets join named using (r)"""


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its proof, and the root folded from a copy in
    which n_chars is one more where 7 divides crc32(doc_id)."""
    docs = _table(spark, sf_dir, "documents")
    fields = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = docs.select(
        "doc_id", "lang", merkle.digest(merkle.leaf_text(fields(F.col("n_chars")))).alias("leaf"),
        F.when(tampered, merkle.digest(merkle.leaf_text(fields(F.col("n_chars").cast("decimal(20,0)") + 1)))).alias("other"))
    rows, name = merkle.manifest(leaves, "leaf", "lang", "doc_id")
    proof = F.col(name)
    out = rows.select(
        "doc_id", merkle.hexed(F.col("leaf")).alias("leaf"), *[merkle.hexed(proof[c]).alias(c) for c in ("subroot", "root")],
        F.sha2(merkle.hexed(F.concat(proof["siblings"], proof["group_siblings"])).cast("binary"), 256).alias("proof_sha256"),
        merkle.hexed(merkle.verify(F.coalesce("other", "leaf"), name)).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of the bytes of ``id`` in ``ids``, from the polynomial; DuckDB has no such function.
CRC = r"""
bits as (select r.range as place, r.range as v, 0 as step from range(256) r),
folded(place, v, step) as (
  select place, v, step from bits
  union all select place, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, step + 1 from folded where step < 8),
lookup as (select list(v order by place) as t from folded where step = 8),
crc as (
  select id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) as crc
  from ids, lookup)"""

ORACLE["op11_merkle_manifest"] = r"""
with recursive ids as (select distinct doc_id as id from documents),
""" + CRC.lstrip() + r""",
told as (
  select doc_id, lang, n_chars, coalesce(crc % 7 = 0, false) as hit, text, source from documents left join crc on id = doc_id),
written as (
  select doc_id, lang, hit,
         coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') as a, n_chars, coalesce(strlen(text) || ':' || text, '-') as b from told),
leaf as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as place, count(*) over (partition by lang) as width,
         sha256(a || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || b) as leaf,
         sha256(a || coalesce(strlen(cast(n_chars + hit::int as varchar)) || ':' || (n_chars + hit::int), '-') || b) as now
  from written),
node(lang, level, idx, width, digest) as (
  select lang, 0, place, width, leaf from leaf
  union all
  select lang, level + 1, idx // 2, (any_value(width) + 1) // 2, sha256(string_agg(digest, '' order by idx))
  from node where width > 1 group by lang, level, idx // 2),
subroot as (
  select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as width
  from node where width = 1),
top(level, idx, width, digest) as (
  select 0, place, width, subroot from subroot
  union all
  select level + 1, idx // 2, (any_value(width) + 1) // 2, sha256(string_agg(digest, '' order by idx)) from top where width > 1 group by level, idx // 2),
height as (select max(level) as height from top),
path as (
  select doc_id, level, s.digest as sibling from leaf join node s on s.lang is not distinct from leaf.lang and s.idx = xor(leaf.place >> s.level, 1)
  union all
  select doc_id, 100 + level, s.digest from leaf join subroot r on r.lang is not distinct from leaf.lang join top s on s.idx = xor(r.place >> s.level, 1)),
proof as (select doc_id, sha256(string_agg(sibling, '' order by level)) as proof_sha256 from path group by doc_id),
fold(doc_id, lang, level, idx, width, digest) as (
  select doc_id, lang, 0, place, width, now from leaf
  union all
  select f.doc_id, f.lang, f.level + 1, f.idx // 2, (f.width + 1) // 2,
         sha256(case when f.idx % 2 = 0 then f.digest || coalesce(s.digest, '') else s.digest || f.digest end)
  from fold f left join node s on s.lang is not distinct from f.lang and s.level = f.level and s.idx = xor(f.idx, 1) where f.width > 1),
over_top(doc_id, level, idx, width, digest) as (
  select f.doc_id, 0, r.place, r.width, f.digest from fold f join subroot r on r.lang is not distinct from f.lang where f.width = 1
  union all
  select f.doc_id, f.level + 1, f.idx // 2, (f.width + 1) // 2,
         sha256(case when f.idx % 2 = 0 then f.digest || coalesce(s.digest, '') else s.digest || f.digest end)
  from over_top f left join top s on s.level = f.level and s.idx = xor(f.idx, 1) where f.width > 1)
select doc_id, leaf, subroot, apex.root,
       coalesce(proof_sha256, sha256('')) as proof_sha256, o.digest as folded_root, o.digest = apex.root as verified
from leaf join subroot r on r.lang is not distinct from leaf.lang left join proof using (doc_id) join over_top o using (doc_id)
cross join (select digest as root from top where width = 1) apex
where o.width = 1"""


@_query
def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))))


ORACLE["op13_prefix_trie"] = r"""
with recursive ids as (select distinct conv_id as id from conversations where conv_id is not null),
""" + CRC.lstrip() + r""",
said as (
  select conv_id as id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place,
         strlen(coalesce(text, '')) as bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as said
  from conversations where conv_id is not null),
turns as (
  select id, place, said, bytes from said join crc using (id) where place >= crc % 9
  union all
  select c.id, place - 100, said, bytes from crc c join said s on s.id = c.id - c.id % 5 and place < crc % 9),
seq as (
  select ids.id, coalesce(list(struct_pack(said := said, bytes := bytes) order by place) filter (said is not null), []) as turns
  from ids left join turns on turns.id = ids.id group by ids.id),
member as (
  select id, d.range as depth, sha256(array_to_string(list_transform(turns[1:d.range], lambda u: u.said), '')) as node,
         sha256(array_to_string(list_transform(turns[1:d.range - 1], lambda u: u.said), '')) as up,
         case when d.range = 0 then 0 else turns[d.range].bytes end as bytes, len(turns) = d.range as ends
  from seq, range(0, 10000) d where d.range <= len(turns)),
node as (
  select node, any_value(case when depth > 0 then up end) as up, any_value(depth) as depth, min(id) as conv_id, count(*) as n_convs,
         (count(*) - 1) * any_value(bytes) as saved,
         sha256(coalesce(string_agg(cast(id as varchar), ',' order by id) filter (ends), '')) as ends_sha256
  from member group by node),
kids as (select up as node, count(*) as n_children from node group by up),
line(node, above, saved, leaf) as (
  select n.node, n.node, n.saved, k.node is null from node n left join kids k using (node)
  union all
  select l.node, n.up, l.saved, l.leaf from line l join node n on n.node = l.above where n.up is not null),
total as (select above as node, sum(leaf::int) as n_leaves, sum(saved) as saved_tokens from line group by above)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from node n left join node p on p.node = n.up left join kids k on k.node = n.node join total t on t.node = n.node"""


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries and their SQL, the pipeline among them."""
    import corpus_pipeline

    oracle = dict(ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        oracle["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, oracle
