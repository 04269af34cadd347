"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import edit_groups, format_copies, leaks, mixture, personal_info, quota_sample, sentences, split_overlap, terms
from corvane.llm.common import norm_source, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _wide() -> tuple[str, str]:
    """Full-width letters and digits, and what they stand for."""
    wide = [chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b)]
    return "".join(wide), "".join(chr(ord(c) - 0xFEE0) for c in wide)


def _words(col: str) -> str:
    """SQL for the list of a text's words: full-width forms narrowed, without case."""
    wide, narrow = _wide()
    return f"regexp_extract_all(replace(lower(nfc_normalize(translate({col}, '{wide}', '{narrow}'))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


def _bags(source: str) -> str:
    """CTEs bag (id, n) and tok (id, n, w, k) of texts of at least 12 words; `source` selects (id, text)."""
    return f"""src as ({source}), ws as (select id, {_words('text')} as l from src where text is not null),
    bag as (select id, l, len(l) as n from ws where len(l) >= 12),
    occ as (select id, n, unnest(l) as w from bag),
    tok as (select id, n, w, row_number() over (partition by id, w) as k from occ)"""


_OVERLAP = "select a.id as x, b.id as y from tok a join tok b on a.w = b.w and a.k = b.k and a.id < b.id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) {where} group by a.id, b.id, a.n, b.n having 5 * count(*) >= 4 * greatest(a.n, b.n)"


# --- 1: the same records across splits

_P1 = f"""with {_bags('select doc_id as id, text from split_rows where split is not null')}, side as (select doc_id as id, lower(trim(split)) = 'train' as train from split_rows where lower(trim(split)) in ('train', 'validation', 'test')),
  link as ({_OVERLAP.format(where="join side s on s.id = a.id join side t on t.id = b.id and s.train <> t.train")})
  select x as doc_id_a, y as doc_id_b from link"""


@query("p1_stored_splits", _P1)
def p1_stored_splits(spark, sf_dir):
    """The overlaps among rows whose split is stored; SQL has no unsigned hash to derive the others' with."""
    return split_overlap.found(table(spark, sf_dir, "split_rows").where("split is not null"), table(spark, sf_dir, "cache_manifest"))


@query("p1_found")
def p1_found(spark, sf_dir):
    return split_overlap.found(table(spark, sf_dir, "split_rows"), table(spark, sf_dir, "cache_manifest"))


@query("p1_report")
def p1_report(spark, sf_dir):
    return split_overlap.report(table(spark, sf_dir, "split_rows"), table(spark, sf_dir, "cache_manifest"))


# --- 2: near-duplicates with small edits


_P2 = f"""with recursive {_bags('select review_id as id, review_text as text from reviews')}, link as ({_OVERLAP.format(where="")}),
  edge as (select x, y from link union select y, x from link),
  reach(id, root) as (select x, x from edge union select e.y, r.root from reach r join edge e on e.x = r.id)
  select min(root) as first_review_id, id as review_id from reach group by id having min(root) < id"""


@query("p2_found", _P2)
def p2_found(spark, sf_dir):
    return edit_groups.groups(table(spark, sf_dir, "reviews")).select(F.col("first_id").alias("first_review_id"), F.col("id").alias("review_id"))


# --- 3: frequency of every term

_TERMS = """
with r as (select review_id, review_text from reviews where review_text is not null and review_text <> ''),
k as (select review_id, lower(unnest(regexp_extract_all(review_text, '[A-Za-z]+'))) as term from r),
a as (select term, count(*) as occurrences, count(distinct review_id) as reviews from k group by term),
m as (select term, occurrences, reviews, case when reviews < 3 then 'rare' when reviews > 0.2 * (select count(*) from r) then 'common' end as mark from a)
"""


@query("p3_found", _TERMS + "select term, mark from m where mark is not null")
def p3_found(spark, sf_dir):
    return terms.term_statistics(table(spark, sf_dir, "reviews")).where("mark is not null").select("term", "mark")


@query("p3_terms", _TERMS + "select term, occurrences, reviews, mark from m")
def p3_terms(spark, sf_dir):
    return terms.term_statistics(table(spark, sf_dir, "reviews"))


# --- 4: sample matching target proportions

_USABLE = """
with usable as (
  select review_id, case lower(trim(sentiment, ' ' || chr(9) || chr(10) || chr(13))) when 'negative' then 0 when '0' then 0 when 'neutral' then 1 when '1' then 1 when 'positive' then 2 when '2' then 2 end as label,
         lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) as source
  from reviews where review_text is not null and review_text <> ''),
c as (select t.plan_id, t.label, lower(trim(t.source)) as source, t.target_share, t.sample_frac, t.min_rows,
        (select count(*) from usable u where u.label is not null and (t.source is null or u.source = lower(trim(t.source)))) as usable,
        (select count(*) from usable u where u.label = t.label and (t.source is null or u.source = lower(trim(t.source)))) as available
      from sample_targets t),
w as (select *, target_share * sample_frac * usable as wanted from c)
"""


@query("p4_found", _USABLE + "select cast(plan_id as int) as plan_id, cast(label as int) as label from w where available < greatest(wanted, min_rows)")
def p4_found(spark, sf_dir):
    return quota_sample.report(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "sample_targets")).where("unmet").select("plan_id", "label")


@query("p4_report", _USABLE + """select cast(plan_id as int) as plan_id, cast(label as int) as label, source, cast(usable as bigint) as usable, cast(available as bigint) as available, round(wanted, 4) as wanted,
  cast(min_rows as int) as min_rows, cast(least(greatest(round(wanted), min_rows), available) as bigint) as drawn, cast(greatest(ceil(greatest(wanted, min_rows)) - available, 0) as bigint) as gap, available < greatest(wanted, min_rows) as unmet from w""")
def p4_report(spark, sf_dir):
    return quota_sample.report(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "sample_targets")).drop("raked").withColumn("wanted", F.round("wanted", 4))


@query("p4_margins")
def p4_margins(spark, sf_dir):
    return quota_sample.margins(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "sample_targets"))


@query("p4_sample_sizes", _USABLE + "select cast(plan_id as int) as plan_id, cast(label as int) as label, cast(least(greatest(round(wanted), min_rows), available) as bigint) as records from w where least(greatest(round(wanted), min_rows), available) > 0")
def p4_sample_sizes(spark, sf_dir):
    return quota_sample.sample(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "sample_targets")).groupBy("plan_id", "label").agg(F.countDistinct("review_id").alias("records"))


@query("p4_sample")
def p4_sample(spark, sf_dir):
    return quota_sample.sample(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "sample_targets"))


# --- 5: personal information


@query("p5_found")
def p5_found(spark, sf_dir):
    return personal_info.items(table(spark, sf_dir, "reviews")).select("review_id", "kind", "item")


@query("p5_redacted")
def p5_redacted(spark, sf_dir):
    return personal_info.redacted(table(spark, sf_dir, "reviews"))


# --- 6: copies hidden by formatting


@query("p6_found")
def p6_found(spark, sf_dir):
    return format_copies.copies(table(spark, sf_dir, "reviews"))


@query("p6_records")
def p6_records(spark, sf_dir):
    return format_copies.records(table(spark, sf_dir, "reviews"))


# --- 7: evaluation texts in the corpus


_P7 = f"""with d as (select doc_id, {_words('text')} as l from documents where text is not null), i as (select item_id, {_words('text')} as l from eval_items where text is not null),
  dg as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(l) - 10, 1)), lambda k: hash(l[k : k + 11]))) as g from d),
  ig as (select distinct item_id, unnest(list_transform(range(1, greatest(len(l) - 10, 1)), lambda k: hash(l[k : k + 11]))) as g from i)
  select distinct item_id, doc_id from dg join ig using (g)"""


@query("p7_found", _P7)
def p7_found(spark, sf_dir):
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p7_leaks")
def p7_leaks(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# --- 8: mixing sources to target weights

_MIX = """
with d as (select lower(trim(source)) as source, n_tokens from documents),
s as (select source, cast(sum(n_tokens) as bigint) as source_tokens from d group by source),
m as (select t.*, coalesce(s.source_tokens, 0) as source_tokens, t.target_share * t.budget_frac * (select coalesce(sum(n_tokens), 0) from d) as target_tokens
      from mix_targets t left join s on s.source = lower(trim(t.source)))
"""


@query("p8_found", _MIX + "select mix_id, source from m where max_repeats * source_tokens < target_tokens")
def p8_found(spark, sf_dir):
    return mixture.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).where("short").select("mix_id", "source")


@query("p8_bounds", _MIX + """, b as (select s.source, max(n_tokens) as largest from d join s using (source) group by s.source)
  select mix_id, m.source, round(target_tokens, 3) as target_tokens, cast(source_tokens as bigint) as source_tokens, max_repeats * source_tokens < target_tokens as short, true as within_one_document, true as within_repeats from m""")
def p8_bounds(spark, sf_dir):
    """The drawn tokens and repeats against what the rounding promises: less than one document off, no source beyond its repeats."""
    docs = table(spark, sf_dir, "documents")
    largest = mixture.sizes(docs).groupBy("source").agg(F.max("tokens").alias("largest"))
    r = mixture.report(docs, table(spark, sf_dir, "mix_targets"))
    r = r.withColumn("key", norm_source("source")).join(largest.withColumnRenamed("source", "key"), "key", "left")
    due = F.least(F.col("target_tokens"), (F.col("max_repeats") * F.col("source_tokens")).cast("double"))
    return r.select("mix_id", "source", F.round("target_tokens", 3).alias("target_tokens"), "source_tokens", "short", (F.abs(F.col("drawn_tokens") - due) <= F.coalesce("largest", F.lit(0))).alias("within_one_document"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


@query("p8_report")
def p8_report(spark, sf_dir):
    return mixture.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p8_mix")
def p8_mix(spark, sf_dir):
    docs, mixes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixture.mix(docs, mixture.plan(docs, mixes))


# --- 9: sentence units


@query("p9_found")
def p9_found(spark, sf_dir):
    return sentences.sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "start_char", "end_char")
