"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, importance, language_id, lm_scoring, quality_rules, quality_trees, secrets
from .common import bound_batches, documents
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .packing import pack
from .token_files import read_token_files, write_token_files


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP4_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
k as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as dropped from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from m group by doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    trees = quality_trees.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_trees.score(docs.withColumn("tie", F.xxhash64("text")), trees)
    out = mix(scored, text_col="tie", weight_col="score", size_col="n_words")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "source", "copies")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=90)


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_trees.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    blocks = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(blocks, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_held_out(documents(spark, sf_dir).select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return filter_audit.audit(filter_audit.failure_counts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.digests(secrets.secret_scan(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


# Views of what SQL can say of operators that it cannot express as a whole ------------------------------------------------


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's size and target."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    found = mix(docs).select("source", "source_size", "target").distinct()
    return found.withColumn("target", F.round(F.col("target").cast("double"), 3))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base columns."""
    out = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"), quality_rules.Model.blank())
    return out.drop("probability", "kept")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's base columns."""
    out = op10_lm_scoring(spark, sf_dir).withColumn("base_score", F.round("base_score", 3))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def secret_base_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13's base columns, with the spans that they digest."""
    return secrets.digests(secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), None))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: crc32 of an id as text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, range(0, 8 * length({0}))),
  lambda c, i: case when (case when i % 8 = 0 then xor(c, ascii(substr({0}, i // 8 + 1, 1))) else c end) & 1 = 1
    then xor((case when i % 8 = 0 then xor(c, ascii(substr({0}, i // 8 + 1, 1))) else c end) >> 1, 3988292384)
    else (case when i % 8 = 0 then xor(c, ascii(substr({0}, i // 8 + 1, 1))) else c end) >> 1 end))"""
OP2_SQL = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end t from w),
u as (select doc_id, len(t) n, unnest(t) x from s),
p as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) i from u a join u b on a.x = b.x and a.doc_id != b.doc_id group by 1, 2),
l as (select a, b from p where 100 * i >= 90 * (na + nb - i)),
r(a, b) as (select doc_id, doc_id from s union select r.a, l.b from r join l on l.a = r.b)
select s.doc_id, len(t) n_shingles, min(r.b) component_id from s join r on r.a = s.doc_id group by 1, 2
"""
TARGETS_SQL = f"""
with d as (select source, sum(len({_WORDS.format("coalesce(text, '')")})) z from documents group by 1),
k as (select *, row_number() over (order by source nulls last) - 1 k from d),
c as (select *, [5.0, 2.0, 1.0][k % 3 + 1] w, 2.0 * z cap, 1.5 * sum(z) over () budget from k),
o as (select *, (budget - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, k rows between current row and unbounded following) level from c),
f as (select min_by(level, cap / w) filter (where level * w <= cap) level from o)
select source, cast(z as bigint) source_size, round(least(cap, coalesce(f.level * w, cap)), 3) target from o, f
"""
RULES_SQL = f"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, x) n from (
  select doc_id, unnest(range(1, len(w) - 6)) i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) x from d where len(w) >= 8)),
rep as (select doc_id, count(distinct i + k) n from win, range(0, 8) r(k) where n >= 2 group by 1),
dup as (select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(string_split(t, chr(10))) line from d) where len({_WORDS.format('line')}) > 0 group by 1)
select d.doc_id, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
  len(w) < 20 or 100 * coalesce(rep.n, 0) > 30 * len(w) base_failed
from d left join rep using (doc_id) left join dup using (doc_id)
"""
LM_SQL = f"""
with d as (select doc_id, {_CRC.format('cast(doc_id as varchar)')} % 7 = 2 held_out, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
u as (select doc_id, held_out, unnest(w) x from d),
c as (select x, count(*) c from u where not held_out group by 1),
f as (select (select count(*) from d where not held_out) ends, (select coalesce(sum(c), 0) from c) + (select count(*) from d where not held_out) n,
  (select count(*) from c) + 1 v),
s as (select doc_id, count(c.c) known, sum(log10(coalesce(c.c, 0) + 1)) logs from u left join c using (x) group by 1)
select d.doc_id, held_out, len(w) + 1 n_tokens, coalesce(known, 0) + 1 n_known, cast(f.n as bigint) train_tokens,
  round(coalesce(logs, 0) + log10(f.ends + 1) - (len(w) + 1) * log10(f.n + f.v + 1), 3) base_score
from d left join s using (doc_id), f
"""
#: Each filter, each order and each step by itself.
OP11_SQL = f"""
with recursive d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w from documents),
least as (select t, min(doc_id) m from d group by 1),
lb as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by 1),
f as (select part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > m, false)] x, coalesce(good, false) good, coalesce(toxic, false) toxic
  from d join least using (t) left join lb using (doc_id)),
s as (select part, x, count(*) n, count(*) filter (where good) good, count(*) filter (where toxic) toxic from f group by 1, 2),
o(filter_order) as (select '' union all select filter_order || c from o, unnest(['A', 'B', 'C', 'D', 'E']) u(c) where not contains(filter_order, c)),
st as (select filter_order, cast(k as int) step, [ascii(c) - 64 for c in string_split(left(filter_order, k - 1), '') if c != ''] past, ascii(substr(filter_order, k, 1)) - 64 own
  from o, range(1, 6) r(k) where length(filter_order) = 5),
e as (select part, filter_order, step, own, x[own] fails, len([i for i in past if x[i]]) > 0 gone, len([y for y in x if y]) = 1 alone, n, good, toxic from s, st),
q as (select part, filter_order, step, own, coalesce(sum(n) filter (where not gone and not fails), 0) kept, coalesce(sum(n) filter (where not gone and fails), 0) removed,
  coalesce(sum(n) filter (where gone and fails), 0) redundant, coalesce(sum(n) filter (where fails and alone), 0) unique_fails,
  coalesce(sum(good) filter (where not gone and fails), 0) good_lost, coalesce(sum(toxic) filter (where not gone and fails), 0) toxic_lost from e group by 1, 2, 3, 4)
select part, filter_order, step, {", ".join(f"cast({c} as bigint) {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  cast(sum(removed) over (partition by part, own) as bigint) shapley from q
"""
#: crc32 byte by byte, of the UTF-8 bytes of {0}.
_TABLE = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ (0xEDB88320 if _byte & 1 else 0)
    _TABLE.append(_byte)
OP12_SQL = f"""
with tb as (select {_TABLE}::bigint[] tb),
w as (select doc_id, 0 kind, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents
  union all select item_id, 1, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
g as (select doc_id, kind, unnest(w) x from w union all select doc_id, kind, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select doc_id, kind, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
c as (select x, doc_id, kind, count(*) n from g group by 1, 2, 3),
h as (select x, hex(encode(x)) hx from (select distinct x from c)),
b as (select x, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, cast(length(hx) / 2 as bigint)), lambda i: cast('0x' || substr(hx, 2 * i + 1, 2) as bigint))),
  lambda a, v: xor(a >> 8, list_extract(tb, (xor(a, v) & 255) + 1)))) % 10000 bucket from h, tb),
n as (select doc_id, kind, bucket, sum(n) n from c join b using (x) group by 1, 2, 3),
t as (select bucket, sum(n) filter (where kind = 0) s, sum(n) filter (where kind = 1) t from n group by 1),
k as (select sum(s) s, sum(t) t from t),
gn as (select bucket, cast(floor(1000 * ln((coalesce(t.t, 0) + 1.0::double) * (k.s + 10000) / ((coalesce(t.s, 0) + 1.0::double) * (coalesce(k.t, 0) + 10000)))) as bigint) gain from t, k),
d as (select doc_id, cast(sum(n) as bigint) n_features, cast(sum(n * gain) as bigint) weight from n join gn using (bucket) where kind = 0 group by 1),
e as (select w.doc_id, len(w) words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0)
    + cast(floor(-1000 * ln(-ln((cast('0x' || left(sha256('42:' || w.doc_id), 8) as bigint) + 0.5::double) / 4294967296))) as bigint) score
  from w left join d using (doc_id) where kind = 0),
r as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () n from e where words >= 20)
select e.doc_id, n_features, weight, score, case when rank <= 5 * n // 100 then rank end rank from e left join r using (doc_id)
"""
#: (Longer runs alone are the same as all runs without the short ones.)  A match starts after the pieces that stand between the earlier ones, and those.
_FOUND = """select doc_id, {k} k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint),
    'm': m[i], 'v': v[i]}})) f from (select doc_id, regexp_extract_all(t, {r}) m, regexp_extract_all(t, {r}, {g}) v, string_split_regex(t, {r}) p from d)"""
_ASSIGN = """'(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
SECRETS_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
f as ({_FOUND.format(k=0, g=1, r=_ASSIGN)} union all {_FOUND.format(k=1, g=0, r="'AKIA[A-Z0-9]{12,}'")} union all {_FOUND.format(k=2, g=0, r="'[0-9a-f]{32,}'")}),
g as (select doc_id, k, f.s s, f.s + length(f.m) e from f where length(f.v) >= [8, 16, 32][k + 1]),
j as (select doc_id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex,
  string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' order by s, k) spans from g group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, coalesce(spans, '') spans, sha256(coalesce(spans, '')) base_sha256
from d left join j using (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_trees": op3_quality_trees,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_secret_scan": op13_secret_scan,
    "secret_base_findings": secret_base_findings,
    "mixing_targets": mixing_targets,
    "quality_rule_counts": quality_rule_counts,
    "lm_base_scores": lm_base_scores,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "secret_base_findings": SECRETS_SQL,
    "mixing_targets": TARGETS_SQL,
    "quality_rule_counts": RULES_SQL,
    "lm_base_scores": LM_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return query(spark, sf_dir)

        return run

    return {name: bounded(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
