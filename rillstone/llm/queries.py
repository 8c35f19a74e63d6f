"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import chat, collocations, exact, html, licenses, mixing, packing, pii, quality, rules, simhash, spelling, tokenbin
from rillstone.llm.store import table


def _spread(df: DataFrame) -> DataFrame:
    """A scanned table over as many partitions as there are cores, where its files are few and can't be split so far (one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]  # reads no column
    return df if parts >= cores else df.repartition(cores)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = [*pii.PATTERNS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined([*base, *pii.EXTRA]).alias("spans"),
        pii.joined([*base, *pii.EXTRA], score=True).alias("scored"),
        sum((F.size(k) for k in [*base, *pii.EXTRA]), F.lit(0)).cast("long").alias("n_found"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    told = quality.scored(docs, model).select("row.doc_id", "score")
    return told.select(
        "doc_id", (~quality.learnable()).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_turns(turns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = rules.judge(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_tokens(spark, tokenbin.write_tokens(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = exact.exact_groups(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_spread(table(spark, sf_dir, "pages")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_spread(table(spark, sf_dir, "documents").select("lang", "text")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html": op9_html,
    "op10_packing": op10_packing,
    "op11_licenses": op11_licenses,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {}

ORACLE["op7_mixing"] = r"""
with d as (
  select doc_id, text, source,
         case when coalesce(text, '') = '' then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s
), t as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio,
         (sum(source_size) over ())::double * 1.5::double as budget, sum(weight) over () as all_weight
  from w
), u as (
  select *, budget - (sum(cap) over r - cap) as rest, all_weight - (sum(weight) over r - weight) as rest_weight
  from t window r as (order by ratio, source nulls last rows unbounded preceding)
), f as (
  select *, (select min_by(rest / rest_weight, (ratio, source)) from u where rest * weight <= cap * rest_weight) as level from u
), r as (
  select source, source_size,
         case when level is null or level * weight > cap then cap else level * weight end as target
  from f
), x as (
  select d.doc_id, d.size, r.source_size, r.target,
         case when r.source_size > 0 then r.target / r.source_size else 0 end as rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, d.text, '')), 1, 13))::bigint::double / 4503599627370496.0::double as v
  from d join r on d.source is not distinct from r.source
)
select doc_id, size, source_size, target,
       ((floor(rate) + case when v < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken
from x
"""

ORACLE["op8_exact_dedup"] = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

ORACLE["op3_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, k, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(k, role)
), e as (
  select *, 20 + length(regexp_replace(role, '(\\|<turn>|</role>|</turn>)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|<turn>|</role>|</turn>)', '\\\1', 'g')) as chars
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

ORACLE["op12_spelling"] = """
with recursive t(crc) as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) from range(256) r(i)
), r as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents
), c as (
  select doc_id, run, count(*) as n from r where length(run) >= 6 group by all
), b as (
  select run, n, list_transform(range(1, 2 * strlen(x) + 1, 2), lambda i: ('0x' || substr(hex(x), i, 2))::bigint) as bytes from (select run, n, coalesce(doc_id::varchar, '') || ':' || run as x from c)
), h as (
  select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, y: xor(acc // 256, crc[(xor(acc, y) % 256 + 1)::int])), 4294967295) as h from b, t
), v as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h
), w as (
  select word, sum(n)::bigint as n from v where length(word) >= 6 group by 1 having sum(n) >= 5
), g as (
  select word, n, unnest(list_prepend(word, list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)))) as part, unnest(range(-1, length(word))) as at from w
), p as (
  select distinct x.word, x.n, y.word as near, y.n as near_n from g x join g y on x.part = y.part and x.word <> y.word where x.at = y.at or least(x.at, y.at) = -1
), f as (
  select word, n, count(near) as n_near, max(near_n) as best_n, min_by(near, (-near_n, near)) as best from (select w.word, w.n, near, near_n from w left join p using (word)) group by all
), s as (
  select word, n, n_near, case when best_n >= 5 * n then best end as form, case when best_n >= 5 * n then best_n end as form_n from f
), k(word, root, form) as (
  select word, word, form from s union all select k.word, s.word, s.form from k join s on k.form = s.word
)
select s.word, s.form, k.root, s.n, s.n_near, s.form_n from s join k on s.word = k.word and k.form is null
"""

ORACLE["op13_collocations"] = r"""
with d as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), p as (
  select lang, row_number() over () as piece_id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from d
), w as (
  select lang, piece_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from p
), g as (
  select lang, w as w1, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by piece_id order by i)
), u as (
  select lang, w1 as phrase, count(*)::hugeint as f from g group by all
), b as (
  select lang, w1, w2, w1 || ' ' || w2 as phrase, count(*)::hugeint as f from g where w2 is not null group by all
), t as (
  select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 as phrase, count(*)::hugeint as f from g where w3 is not null group by all having count(*) >= 10
), c as (
  select b.lang, b.phrase, 1 as cut, b.f as a, l.f as l, r.f as r from b join u l on b.lang = l.lang and b.w1 = l.phrase join u r on b.lang = r.lang and b.w2 = r.phrase where b.f >= 10
  union all
  select t.lang, t.phrase, 1, t.f, l.f, r.f from t join u l on t.lang = l.lang and t.w1 = l.phrase join b r on t.lang = r.lang and t.w2 = r.w1 and t.w3 = r.w2
  union all
  select t.lang, t.phrase, 2, t.f, l.f, r.f from t join b l on t.lang = l.lang and t.w1 = l.w1 and t.w2 = l.w2 join u r on t.lang = r.lang and t.w3 = r.phrase
), s as (
  select *, (1000000::hugeint * a * a) // (l * r) as score from c
), m as (
  select *, row_number() over (partition by lang, phrase order by score, cut) as nth from s
), x as (
  select lang, phrase, max(f) as f from (select lang, w1 || ' ' || w2 as phrase, f from t union all select lang, w2 || ' ' || w3, f from t) group by all
), k as (
  select m.lang, m.phrase, m.a, m.l, m.r, m.score from m left join x on m.lang = x.lang and m.phrase = x.phrase where nth = 1 and (x.f is null or 100 * x.f < 50 * m.a)
), o as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k
)
select o.lang, o.rank, o.phrase, o.a::bigint as a, o.l::bigint as l, o.r::bigint as r, n.n, o.score::bigint as score
from o join (select lang, count(*) as n from w group by 1) n on o.lang = n.lang where o.rank <= 2000
"""
