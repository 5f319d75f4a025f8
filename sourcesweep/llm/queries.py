"""The queries of this package: each operator over its whole table, with the parameters for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, divergence, exact_dedup, html, near_dedup, pii, quality, resampling, secrets, substrings, toxicity

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _written(spans: str, base: str | None = None):
    kept = F.filter(spans, lambda s: s["kind"] != base) if base else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", _count("assign"), _count("access"), _count("hex"),
                        F.sha2(_written("spans", "random"), 256).alias("base_sha256"), _written("spans").alias("spans"), _count("random"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
                        F.col("longest").alias("longest_match"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    return bpe.encode(table(spark, sf_dir, "documents"), path, back=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.read_back(chat.format_conversations(turns.union(own)))
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["piece"])), "")
    return made.withColumn("_under", under).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_under").cast("long").alias("loss_chars"), F.sha2("_under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("valid").alias("in_order"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[_count(k) for k in pii.KINDS], F.sha2(_written("spans", "likely"), 256).alias("base_sha256"),
                        _written("spans").alias("spans"), _count("likely"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("passages").cast("long").alias("n_passages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_circulant_minhash, op4_substring_dedup, op5_bpe, op6_chat_format,
                                   op7_pii, op8_quality_rules, op9_toxicity, op10_html_extraction, op11_source_divergence, op12_importance_resampling,
                                   op13_exact_dedup)}

#: Equal SQL, where SQL can say it.
ORACLES: dict[str, str] = {}

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '<turn:', '<\turn:'), ':turn>', ':\turn>'), '</turn>', '<\/turn>')"
ORACLES["op6_chat_format"] = rf"""
with said(text) as (select '\### Assistant: </turn> ok'),
turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', text from said
    union all select -7, 1, 'assistant', text from said),
steps as (select *, coalesce(lag(role) over (partition by conv_id order by turn), 'start') || '>' || role as step from turns)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(19 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::bigint as formatted_chars,
    bool_and(step in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
        and arg_max(role, turn) = 'assistant' as in_order
from steps group by conv_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
ORACLES["op11_source_divergence"] = f"""
with docs as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '{_TERMS}') as terms from documents),
uses as (select doc_id, lang, source, unnest(terms) as term from docs),
counts as (select lang, source, term, count(*) as n from uses group by all),
kept as (select lang, term, count(*) as n from uses group by all having count(distinct doc_id) >= 3),
langs as (select lang, sum(n)::hugeint as total, count(*)::hugeint as terms from kept group by all),
groups as (select lang, source, coalesce(sum(k.n), 0)::hugeint as total
    from (select distinct lang, source from docs) left join (select c.* from counts c semi join kept using (lang, term)) k using (lang, source) group by all),
prices as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.terms) as p,
        1 + (1000000000 * (k.n::hugeint + 1)) // (l.total + l.terms) as q
    from groups g join langs l using (lang) join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select g.lang, g.source, h.source as item, coalesce(s.value, 0) as value from groups g join groups h on h.lang = g.lang and h.source <> g.source
    left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
        from prices a join prices b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
    on s.lang = g.lang and s.source = g.source and s.item = h.source),
tops as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from prices where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pairs
union all select lang, source, 'term', item, value::bigint, row_number() over (partition by lang, source order by value desc, item)::integer as rank from tops
    qualify rank <= 200"""
ORACLES["op13_exact_dedup"] = f"""
with norm as (select doc_id, {_LOWER} as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from norm window same as (partition by text)"""
