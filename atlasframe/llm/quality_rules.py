"""Host-level quality rules, in DataFrame functions only.

Each document is measured and fails or passes the base rules; failures are
summed by host, host rates are shrunk towards an empirical beta prior, and the
verdict of the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import table

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeats(rows: DataFrame) -> DataFrame:
    """n_repeat_words from the column words: words in a 5-word window that is
    found twice or more in the text. Windows are compared by 64-bit hash; only
    texts in which one comes back have their windows sorted."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))  # each word once
    item = lambda i, k: F.get("hashes", (i + k).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(item(i, k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("again"), placed))

    def twin(x: Column, i: Column) -> Column:
        before = F.get("placed", (i - 1).cast("int"))["h"]
        after = F.get("placed", (i + 1).cast("int"))["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    rows = rows.withColumn("at", F.when(F.col("again"), F.sort_array(F.transform(F.filter("placed", twin), lambda x: x["i"]))))
    steps = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", (i + 1).cast("int")) - x, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    rows = _repeats(rows)
    return rows.select(
        "id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, host_rate): the mean of each host's beta posterior, its share of failed
    documents shrunk by a prior that is fitted to all hosts by moments (documents as
    weights). The prior weighs as many documents as the hosts' spread beyond chance
    tells, 1 at least and 1,000,000 at most, where they hardly differ (a spread of
    less than 1e-9 counts as that)."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    # Three sums over all hosts; n * p * p is f * f / n.
    n, f, hosts_n, ff = hosts.agg(F.sum("n"), F.sum("f"), F.count("*"), F.sum(F.col("f") * F.col("f") / F.col("n"))).first()
    if not n:
        return hosts.select("host", F.lit(0.0).alias("host_rate"))
    mean = f / n
    spread = mean * (1 - mean)
    between = max(ff / n - mean * mean - spread * hosts_n / n, 1e-9)
    weight = min(max(spread / between - 1, 1.0), 1e6)
    return hosts.select("host", ((F.col("f") + mean * weight) / (F.col("n") + weight)).alias("host_rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, repeat_percent: int = 20, host_limit: float = 0.5) -> DataFrame:
    """One row per document: the measures, base_failed, host_rate and kept.

    A document is kept if it passes the base rules and its host's shrunk failure
    rate is at most host_limit. Null and empty texts have no words and fail; very
    long ones are measured whole. Documents with a null host form one host. Repeated
    rows and rows with null ids are judged each; other columns are ignored; an empty
    table gives an empty result.
    """
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    judged = table(measures(docs, id_col, text_col, host_col).withColumn("base_failed", failed), "rules")
    rates = host_rates(judged)
    joined = judged.join(rates.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit)).withColumnRenamed("id", id_col)


#: word_chars and the like by the contract; the same moments as host_rates().
ORACLE = r"""
with w as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (
  select doc_id, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
keyed as (select doc_id, i, words[i:i+4] as win from win),
twice as (select doc_id, i, count(*) over (partition by doc_id, win) as c from keyed),
rep as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice where c > 1) group by doc_id),
li as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
dup as (
  select doc_id, count(*) - count(distinct line) as n from li where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select w.doc_id, source, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep on rep.doc_id = w.doc_id left join dup on dup.doc_id = w.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
h as (select source, count(*) as n, sum(case when base_failed then 1 else 0 end) as f from b group by source),
t as (select sum(n) as n, sum(f) / sum(n) as mu, count(*) as hosts, sum(f * f / n) as ff from h),
k as (select mu, least(greatest(mu * (1 - mu) / greatest(ff / n - mu * mu - mu * (1 - mu) * hosts / n, 1e-9) - 1, 1.0), 1e6) as weight from t),
r as (select source, (f + mu * weight) / (n + weight) as rate from h cross join k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rate <= 0.5 as kept, round(rate, 6) as host_rate
from b left join r on b.source is not distinct from r.source
"""
