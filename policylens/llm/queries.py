"""The registered queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.llm import (
    bpe, clustering, decontaminate, langid, quality, revisits, simhash, spelling, substrings, suffix_array, topk, toxicity, word_bpe,
)
from policylens.llm.common import bucket_of, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> tuple[str, str]:
    """The rank file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


OP1_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
tests as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item_id, w, least(len(w), 10) as n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i
        from item_words where len(w) > 0)),
windows as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
        from doc_words, (select distinct n from tests))),
hits as (select doc_id, i, windows.n, item_id from windows join tests using (win)),
covered as (
  select doc_id, count(distinct k) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from hits) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hits where item_id is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join covered using (doc_id) left join named using (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, *byte_vocabulary(), keep=["doc_id"]).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """One row per labelled id that may be learned from; an id with several labels takes the largest."""
    labels = table(spark, sf_dir, "labels")
    return labels.where(bucket_of(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max(label).alias(label))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "flagged",
    )


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = written(quality.measured(docs, keep=["doc_id"]), "op9-statistics")
    model = quality.fit(rows.join(_labels(spark, sf_dir, "quality"), "doc_id"))
    return quality.score(rows, model).select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_suffix_array")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with doc_words as (select distinct doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') as win
  from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from doc_words)),
later as (
  select doc_id, i from (select doc_id, i, rank() over (partition by win order by doc_id, i) as k from windows) where k > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as k from later),
cut as (select doc_id, list(k) as ks, count(*) as n_removed from gone group by doc_id),
kept as (
  select doc_id, string_agg(word, ' ' order by k) as words
  from (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as k from doc_words) anti join gone using (doc_id, k)
  group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(words, '')) as kept_sha256
from documents join doc_words using (doc_id) left join cut using (doc_id) left join kept using (doc_id)
"""


@query("op7_substrings", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score
  from v as q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id and len(q.x) = len(v.x))
select query_id, cast(k as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from scored) where k <= 10
"""


@query("op2_top_k", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("x"))
    return topk.search(rows, rows.where(F.col("id") % 100 == 0), 10)


OP8_SQL = r"""
with cut as (
  select page_id as p, coalesce(html, '') as html,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages),
parts as (
  select p, html, regexp_extract(bare, '^[^/?]*') as host,
    substring(bare, length(regexp_extract(bare, '^[^/?]*')) + 1) as rest from cut),
keyed as (
  select p, html,
    regexp_replace(regexp_replace(lower(host), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '([?&])utm_[a-z]+=[^&]*', '\1', 'g'),
       '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&/]+$', '') as url_key,
    '"' || substring(md5(html), 1, 12) || '"' as tag, 'T' || cast(p * 10 - p % 7 as varchar) as changed from parts),
records as (
  select 2 * p as record_id, url_key, p * 10 as ts, false as asks, p % 17 <> 0 as is_full, tag, changed,
    strlen(html) as size, sha256(html) as digest from keyed
  union all
  select 2 * p + 1, url_key, p * 10 + 5 + p % 3 * 40000, true, false,
    case p % 5 when 0 then null when 1 then 'W/' || tag when 2 then '"old"' else tag end,
    case when p % 5 = 0 and p % 2 = 0 then changed end, null, null from keyed),
placed as (
  select *, last_value(case when is_full then {'id': record_id, 'ts': ts, 'tag': tag, 'changed': changed, 'size': size, 'digest': digest} end
    ignore nulls) over (partition by url_key order by ts, record_id rows between unbounded preceding and 1 preceding) as r
  from records),
judged as (
  select *, case when url_key is null or r is null then 'no_response'
    when tag is not null and r.tag is not null then
      case when regexp_replace(tag, '^W/', '') = r.tag then 'resolved' else 'mismatch' end
    when changed is not null and r.changed is not null then
      case when changed = r.changed then 'resolved' else 'mismatch' end
    else 'unverified' end as outcome
  from placed where asks)
select record_id, url_key, outcome, r.id as response_id,
  case when outcome = 'resolved' then r.digest end as response_digest,
  case when outcome = 'resolved' then
    'cache-control: max-age=900' || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: D' || ts || chr(10) || 'etag: ' || coalesce(tag, r.tag) || chr(10) || 'last-modified: ' || r.changed end as headers
from judged
"""


@query("op8_warc_revisits", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "url_key", "outcome", "response_id", "response_digest", revisits.header_lines(F.col("merged")).alias("headers")
    )


def _op11_sql(k: int, rounds: int) -> str:
    """The rounds written out one after the other."""
    steps = [
        f"""a{i} as materialized (
  select vec_id, x, arg_min(cluster, (d, cluster)) as cluster, min(d) as d
  from (select r, vec_id, x, c{i}.cluster, list_sum(list_transform(list_zip(x, c{i}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{i})
  group by r, vec_id, x)"""
        for i in range(rounds + 1)
    ]
    moves = [
        f"""c{i + 1} as materialized (
  select c{i}.cluster, coalesce(m.c, c{i}.c) as c from c{i} left join (
    select cluster, list(s order by j) as c from (
      select cluster, j, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) as s
      from (select cluster, unnest(x) as e, unnest(generate_series(1, {clustering.WIDTH})) as j from a{i}) group by cluster, j)
    group by cluster) as m on m.cluster = c{i}.cluster)"""
        for i in range(rounds)
    ]
    chain = [part for pair in zip(steps, [*moves, ""]) for part in pair if part]
    return f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
  from embeddings where len(embedding) = {clustering.WIDTH}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
c0 as materialized (
  select cast(row_number() over (order by h nulls last, x) - 1 as integer) as cluster, x as c
  from (select sha256('3:' || cast(vec_id as varchar)) as h, x from v order by h nulls last, x limit {k})),
{", ".join(chain)}
select vec_id, a.cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.cluster) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} as a join c{rounds} as c on a.cluster = c.cluster
"""


@query("op11_clustering", _op11_sql(8, 10))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def word_vocabulary() -> str:
    """The tokenizer file with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op12_word_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return word_bpe.encode_documents(docs, word_vocabulary(), keep=["doc_id"]).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


OP13_SQL = r"""
with recursive crc as materialized (
  select list(v order by i) as tab from (
    select i, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as v
    from (select unnest(range(256)) as i))),
found as materialized (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run
    from documents) group by doc_id, run),
hashed as (
  select run, k, xor(list_reduce(
    flatten(list_transform(string_split(cast(doc_id as varchar) || ':' || run, ''),
      lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [cast(192 + (unicode(c) >> 6) as bigint), 128 + (unicode(c) & 63)] end)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as h
  from found, crc),
vocabulary as materialized (
  select word, cast(sum(k) as bigint) as n from (
    select k, case when h % 97 = 0 then left(run, h % length(run)) || substring(run, h % length(run) + 2) else run end as word from hashed)
  where length(word) >= 5 group by word having sum(k) >= 3),
cuts as materialized (
  select word, n, i, left(word, i - 1) || '|' || substring(word, i + 1) as rest
  from (select word, n, unnest(generate_series(1, length(word))) as i from vocabulary)),
longer as (
  select distinct cuts.word as a, cuts.n as an, v.word as b, v.n as bn
  from cuts join vocabulary as v on replace(cuts.rest, '|', '') = v.word),
near as (
  select a.word, b.word as other, b.n as other_n from cuts as a join cuts as b on a.rest = b.rest and a.word <> b.word
  union all select a, b, bn from longer union all select b, a, an from longer),
best as (
  select word, count(*) as n_near, max(other_n) as top, arg_min(other, (-other_n, other)) as other from near group by word),
forms as materialized (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 2 * v.n then other end as form, case when top >= 2 * v.n then top end as form_n
  from vocabulary as v left join best on v.word = best.word),
steps as (
  select word, word as top, 0 as k from forms
  union all select steps.word, forms.form, k + 1 from steps join forms on steps.top = forms.word where forms.form is not null),
ends as (select word, arg_max(top, k) as root from steps group by word)
select forms.word, form, root, n, n_near, form_n from forms join ends on forms.word = ends.word
"""


@query("op13_spelling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
