"""The thin queries of the operators' contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, table, words
from tessera.llm.infill import fill_in_middle, restored
from tessera.llm.langid import identify_languages
from tessera.llm.lines import dedup_lines
from tessera.llm.minhash import minhash_groups
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_verdicts
from tessera.llm.sharding import histogram_sort_shards
from tessera.llm.simhash import hex16, simhash_groups
from tessera.llm.tokens import token_counts
from tessera.llm.topk import exact_top_k, quantised
from tessera.llm.trie import conversation_trie, numbered_turns
from tessera.llm.wrappers import extract_main_text


def _bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size", _bytes() + 16)
    dealt = histogram_sort_shards(docs, n_shards=40, key="doc_id", size="size")
    return dealt.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _bytes().alias("n_bytes"), "text")
    counted = token_counts(docs, model=public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_dropped"))


def op5_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", "lang")
    return identify_languages(docs, learn_from=~F.col("held_out"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, queries=F.col("vec_id") % 50 == 0, k=5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"),
    )


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids after the contract's rebuild: each conversation c begins with the first h turns of conversation c - c % 5."""
    family, head = (F.col("conv_id") - F.col("conv_id") % 5).alias("family"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("head")
    ids = turns.where("pos = 0").select("conv_id")
    heads = turns.where("conv_id % 5 = 0 and pos < 8").withColumnRenamed("conv_id", "family")
    taken = ids.select("conv_id", family, head).join(heads, "family").where("pos < head").select("conv_id", "pos", "t1", "t2", "n_bytes")
    lengths = heads.groupBy("family").agg(F.count(F.lit(1)).alias("held"))
    own = turns.select("*", family, head).where("pos >= head").join(broadcast_if_small(lengths, F.lit(16)), "family", "left")
    place = F.col("pos") - F.col("head") + F.least("head", F.coalesce("held", F.lit(0)))
    return taken.unionByName(own.select("conv_id", place.alias("pos"), "t1", "t2", "n_bytes")), ids


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt_conversations(numbered_turns(table(spark, sf_dir, "conversations")))
    return conversation_trie(turns, ids)


QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_sort, op2_token_counts, op3_simhash_groups, op4_line_dedup, op5_language_profiles,
        op6_page_text, op7_source_mix, op8_quality_rules, op9_exact_top_k, op10_packing, op11_minhash_groups,
        op12_fill_in_middle, op13_conversation_trie,
    )
}

#: The other operators hash with XXH64 or CRC-32, use tokenizer files, or fit models, which SQL cannot; tests
#: hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""with l as (select doc_id, generate_subscripts(x, 1) as n, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
k as (select doc_id, n, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from l),
b as (select doc_id, n, w, len(w) as m, array_to_string(w, ' ') as s, row_number() over (order by doc_id, n) as o from k where len(w) > 0),
f as (select s, min(o) as o, any_value(w) as w, any_value(m) as m from b group by s),
v as (select o, m, i, array_to_string(w[1:i-1] || w[i+1:], ' ') as d from (select o, m, w, unnest(range(1, m + 1)) as i from f where m >= 5)),
near as (select v.o from v join (select m, i, d, min(o) as o from v group by m, i, d having count(*) > 1) g on v.m = g.m and v.i = g.i and v.d = g.d where v.o > g.o
  union select v.o from v join f on v.d = f.s where f.o < v.o and f.m >= 5 union select f.o from v join f on v.d = f.s where v.o < f.o and f.m >= 5),
stay as (select b.doc_id, b.n from b join f on b.o = f.o where f.o not in (select o from near)),
kept as (select k.doc_id, string_agg(line, chr(10) order by k.n) as text, count(*) as c from k left join stay on k.doc_id = stay.doc_id and k.n = stay.n
  where len(k.w) = 0 or stay.n is not null group by k.doc_id)
select d.doc_id, coalesce(kept.text, '') as text, len(string_split(d.text, chr(10))) as n_lines, len(string_split(d.text, chr(10))) - coalesce(c, 0) as n_dropped
from documents d left join kept on d.doc_id = kept.doc_id""",
    "op11_minhash_groups": r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as (select doc_id, coalesce(len(g), 0)::bigint as n from g), s as (select doc_id, unnest(g) as s from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on r.c = e.a)
select doc_id, any_value(n) as n_shingles, min(c) as component_id, min(c) = doc_id as kept from r join n using (doc_id) group by doc_id""",
    "op12_fill_in_middle": r"""with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id::varchar) as h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
d as (select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
    when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form from t),
c as (select *, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b)+1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b)+1:], '') as s from d)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
  sha256(text) as restored_sha256 from c""",
    "op13_conversation_trie": r"""with o as (select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as t,
  octet_length(encode(coalesce(text, ''))) as b, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as i from conversations),
c as (select conv_id, conv_id - conv_id % 5 as f, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end))) % 9 as h
  from (select distinct conv_id from conversations)),
r as (select c.conv_id, 0 as own, i, t, b from c join o on o.conv_id = c.f and i < h union all select c.conv_id, 1, i, t, b from c join o on o.conv_id = c.conv_id and i >= h),
q as (select c.conv_id, list(t order by own, i) filter (t is not null) as t, list(b order by own, i) filter (t is not null) as b from c left join r using (conv_id) group by c.conv_id),
m as (select conv_id, d, array_to_string(t[1:d], ',') as k, case when d > 0 then array_to_string(t[1:d-1], ',') end as pk, coalesce(b[d], 0) as b, coalesce(len(t), 0) as l
  from (select *, unnest(range(coalesce(len(t), 0) + 1)) as d from q)),
n as (select k, d, any_value(pk) as pk, min(conv_id) as conv_id, count(*) as n, any_value(b) as b, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = l), '')) as ends from m group by k, d),
x as (select p.k, p.d, count(*) as x from n join n p on n.pk = p.k and n.d = p.d + 1 group by all),
s as (select m.k, m.d, sum((n.n - 1) * n.b) as saved, count(*) filter (x.x is null) as leaves
  from n left join x on n.k = x.k and n.d = x.d join m on m.conv_id = n.conv_id and m.d <= n.d group by all)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(x.x, 0)::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends as ends_sha256
from n join s on n.k = s.k and n.d = s.d left join x on n.k = x.k and n.d = x.d left join n p on p.k = n.pk and p.d = n.d - 1""",
    "op9_exact_top_k": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p) where rank <= 5""",
}
