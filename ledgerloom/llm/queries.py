"""Registered queries of the operators, each over whole tables with production parameters, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import brown, containment, conversations, embeddings, jaccard, nearest, packing, quality, ranking, rans, separators, sharding, substrings
from ledgerloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

JOIN_WORDS, JOIN_PERCENT = 4, 85
WINDOW = 20
ITEM_WORDS, ITEM_PERCENT = 5, 80
KEEP_FROM = 0.3
LEAST_COSINE = 0.95


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = sql
        return query
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"[x for x in regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+') if x <> '']"


@add("op3_substring_dedup", f"""
with w as (select doc_id, {words_sql('text', False)} as w from documents),
win as (select doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') as v
        from w, unnest(range(1, len(w) - {WINDOW - 2})) as t(s) where len(w) >= {WINDOW}),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by v order by doc_id, s) as k from win) as r where k > 1),
gone as (select distinct doc_id, s + k as p from later, unnest(range(0, {WINDOW})) as t(k)),
word as (select w.doc_id, p, w.w[p] as v from w, unnest(range(1, len(w.w) + 1)) as t(p)),
kept as (select word.doc_id, string_agg(v, ' ' order by p) as v, count(*) as n
         from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by word.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(kept.n, 0))::bigint as n_removed,
       sha256(coalesce(kept.v, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window of twenty are removed."""
    # The place of a row in its file is the same in every reading, however files are split.
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text", place), WINDOW, key="row")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@add("op1_embedding_hnsw", f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
u as (select vec_id, v, sqrt(list_sum([x * x for x in v])) as n from e
      where vec_id is not null and len(v) > 0 and len([x for x in v if x is null or not isfinite(x)]) = 0),
good as (select * from u where n > 0),
link as (select a.vec_id as a, b.vec_id as b from good as a join good as b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
         where list_dot_product(a.v, b.v) / (a.n * b.n) >= {LEAST_COSINE}),
reach(vec_id, other) as (select vec_id, vec_id from e union select reach.vec_id, link.b from reach join link on reach.other = link.a)
select r.vec_id, coalesce(l.n, 0)::bigint as n_links, r.m as component_id, r.m = r.vec_id as kept
from (select vec_id, min(other) as m from reach group by 1) as r left join (select a, count(*) as n from link group by 1) as l on l.a = r.vec_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), LEAST_COSINE)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


@add("op2_brown_classes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by class bigrams, beside that by single words."""
    docs = table(spark, sf_dir, "documents")
    return brown.score(docs.withColumn("held_out", remainder(7) == 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@add("op4_quality_ftrl")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return quality.score(docs, weights).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


@add("op5_rans_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are read back from the coded token files."""
    manifest = rans.write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), "word_bpe_49k.json", 2)
    read = rans.read_token_files(spark, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@add("op6_hilbert_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0, 1024)


@add("op7_separator_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents, found by their end-of-document ids in flat files."""
    return separators.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 50256)


@add("op8_sampled_splitters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sixteen shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@add("op9_ngram_jaccard_join", f"""
with recursive w as (select doc_id, {words_sql('text', True)} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + {JOIN_WORDS - 1}], ' ') as g
      from w, unnest(range(1, greatest(len(w) - {JOIN_WORDS - 1}, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s as a join s as b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select both_.a, both_.b from both_ join n as x on x.doc_id = both_.a join n as y on y.doc_id = both_.b
         where 100 * c >= {JOIN_PERCENT} * (x.n + y.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from w union select reach.doc_id, link.b from reach join link on reach.other = link.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.m as component_id
from w left join n on n.doc_id = w.doc_id join (select doc_id, min(other) as m from reach group by 1) as r on r.doc_id = w.doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are at least 85 % alike."""
    return jaccard.join_similar(table(spark, sf_dir, "documents"), JOIN_WORDS, JOIN_PERCENT)


@add("op10_benchmark_decontamination", f"""
with d as (select doc_id, {words_sql('text', True)} as w from documents),
b as (select item_id, w, least({ITEM_WORDS}, len(w)) as k from (select item_id, {words_sql('text', True)} as w from benchmark) as x where len(w) > 0),
bs as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from b, unnest(range(1, len(w) - k + 2)) as t(i)),
bn as (select item_id, count(*) as n from bs group by item_id),
ds as (select distinct doc_id, v.k, array_to_string(w[i:i + v.k - 1], ' ') as g
       from d, (select distinct k from b) as v, unnest(range(1, len(w) - v.k + 2)) as t(i)),
c as (select doc_id, item_id, count(*) as c from ds join bs on ds.k = bs.k and ds.g = bs.g group by 1, 2)
select c.doc_id, c.item_id, bn.n::bigint as item_shingles, c.c::bigint as shared_shingles
from c join bn on bn.item_id = c.item_id where 100 * c.c >= {ITEM_PERCENT} * bn.n""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least 80 %."""
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ITEM_WORDS, ITEM_PERCENT)


def _crc32_sql(s: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({s}, ''), lambda x: ord(x)::bigint)), {bits}), 4294967295)"


def _more(way: str, cost: str, letter: str) -> str:
    """A way so far (nine digits of cost, then letters) with one more edit; the least text is the best way."""
    return f"lpad((left({way}, 9)::int + {cost})::varchar, 9, '0') || substr({way}, 10) || '{letter}'"


def _repair_sql() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    inserted = (f"select *, least(t2, {_more('s0', '5', 'I')}, {_more('s1', '5', 'I')}, {_more('s3', '5', 'I')}) as w2 "
                "from (select *, s2 as t2 from {src})")
    closed = f"select *, least(s3, {_more('w2', '5', 'I')}) as w3 from ({inserted})"

    def on(test: str, way: str) -> str:
        return f"case when {test} then {way} end"

    def step(way: str) -> str:
        return ", ".join([on("stays", _more(way, "1 + z", "R")), on("stays and kind = 'u'", _more(way, "z", "K"))])

    return f"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations),
dam as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when k = 3 then 2 else 1 end)) as copy from raw where k <> 0),
num as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role)::varchar || ':' || role || ':' || text), copy) as i,
    rtrim(text, {blank}) as core from dam),
judged as (
  select *, left(role, 1) as kind, case when core = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from num),
way as (
  select conv_id, 0::bigint as i, '000000000' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from (select distinct conv_id from dam)
  union all
  select conv_id, i, {_more('s0', '2', 'D')}, least({_more('s1', '2', 'D')}, {on("stays and kind = 's'", _more('s0', 'z', 'K'))}),
    least({_more('w2', '2', 'D')}, {step('s0')}, {step('s1')}, {step('w3')}),
    least({_more('w3', '2', 'D')}, {on("stays", _more('w2', '1 + z', 'R'))}, {on("stays and kind = 'a'", _more('w2', 'z', 'K'))})
  from ({closed.format(src="(select w.conv_id, j.i, s0, s1, s2, s3, kind, fault not in ('blank', 'duplicate') as stays, case fault when 'truncated' then 5 else 0 end as z from way w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1)")})),
best as (
  select conv_id, least(s0, w3) as best from ({closed.format(src="way")})
  qualify row_number() over (partition by conv_id order by i desc) = 1),
letters as (
  select conv_id, p, substr(best, p::int, 1) as letter from best, unnest(range(10, length(best) + 1)) as t(p)),
placed as (
  select l.*, j.role, j.text, l.letter = 'K' and j.kind = 's' as lead
  from (select *, sum((letter <> 'I')::int) over (partition by conv_id order by p) as i from letters) l
  left join judged j on l.letter <> 'I' and j.conv_id is not distinct from l.conv_id and j.i = l.i),
lines as (
  select conv_id, string_agg(case when letter = 'K' then role when n % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as whole
  from (select *, sum((not lead)::int) over (partition by conv_id order by p) as n from placed where letter <> 'D') group by 1),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (was || kind not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(kind) over (partition by conv_id order by i) as was from judged) group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(left(best, 9)::bigint, 0) as cost,
  coalesce(substr(best, 10), '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join best b on b.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
left join stats s on s.conv_id is not distinct from c.conv_id"""


@add("op11_conversation_repair", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERY_STEP, NEIGHBOURS = 100, 10


@add("op12_kmeans_tree_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


HITS = 20


def _terms_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"unnest(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"


@add("op13_block_max_search", f"""
with t as (select doc_id, term, count(*) as tf from (select doc_id, {_terms_sql('text')} as term from documents) as x group by 1, 2),
d as (select doc_id, sum(tf)::bigint as n from t group by 1),
c as (select count(*) as docs, sum(n)::bigint as total from d),
m as (select doc_id, 75 + (25 * n * docs) // total as m from d, c),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from t, c group by 1),
q as (select item_id, term, count(*) as r from (select item_id, {_terms_sql('text')} as term from benchmark) as x group by 1, 2),
s as (select item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from q join w using (term) join t using (term) join m using (doc_id) group by 1, 2)
select item_id, rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= {HITS}""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every test item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), HITS)
