"""Target-distribution importance resampling over hashed n-gram features.

A text is cut by bytes: one 256-byte table lowers A-Z and blanks the separators,
split() yields the words, and an n-gram's bucket comes from crc32 chained over its
words, each seeded with the value so far. Features are counted by Counters inside
each task and summed by bucket, so what is shuffled is at most one row a bucket
and task. The log ratio of a bucket's share in the target to its share in the
corpus is its gain; a document's weight is the mean gain of its features, and
weight plus Gumbel noise from a hash of the id, taken highest first, draws without
replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.llm.shared import table, unused

#: Lowers A-Z, keeps 0-9, a-z and all bytes of other characters, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words whose value a Python worker keeps; it starts afresh beyond them.
CACHE = 300_000
COLUMNS = ("n_words", "n_features", "weight", "score", "rank")


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; none for null."""
    return text.encode().translate(TABLE).split() if text else []


def features_of(words: list[bytes], n: int) -> Iterator[int]:
    """crc32 of every run of 1 to n words, joined by one space, from the runs one word shorter."""
    values = [zlib.crc32(w) for w in words]
    yield from values
    for size in range(2, n + 1):
        # Run i of `size` words goes on from run i of one word less by a space and word i + size - 1.
        values = [zlib.crc32(words[i + size - 1], zlib.crc32(b" ", values[i])) for i in range(len(words) - size + 1)]
        yield from values


def bucket_counts(texts: DataFrame, n: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket int, count long): features of all rows by their hash modulo buckets; buckets without any are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            words: Counter[bytes] = Counter()
            for text in b.column(0).to_pylist():
                if n == 1:
                    words.update(words_of(text))
                else:
                    total.update(f % buckets for f in features_of(words_of(text), n))
            for word, count in words.items():
                total[zlib.crc32(word) % buckets] += count
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "count"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: DataFrame, target: DataFrame, n: int, buckets: int, text_col: str = "text", target_col: str = "text") -> list[int]:
    """The gain of each bucket, in thousandths of a nat, rounded down: one number for
    each of `buckets`, a parameter, whatever the tables' size."""
    own, wanted = ({r["bucket"]: r["count"] for r in bucket_counts(df, n, buckets, col).collect()} for df, col in ((corpus, text_col), (target, target_col)))
    s, t = sum(own.values()), sum(wanted.values())
    ratio = lambda b: float(wanted.get(b, 0) + 1) * float(s + buckets) / (float(own.get(b, 0) + 1) * float(t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight), all long, of every row: weight is the mean
    gain of its features, repeats counted, rounded down, and 0 without features."""
    buckets = len(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                if n == 1:
                    if len(known) > CACHE:
                        known.clear()
                    for w in set(words).difference(known):
                        known[w] = gain[zlib.crc32(w) % buckets]
                    count, total = len(words), sum(map(known.__getitem__, words))
                else:
                    values = [gain[f % buckets] for f in features_of(words, n)]
                    count, total = len(values), sum(values)
                n_words.append(len(words))
                n_features.append(count)
                weight.append(total // count if count else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=[id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id's hash; a null id hashes as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, share: int, least_words: int, id_col: str = "doc_id") -> DataFrame:
    """rows (with n_words, score) and rank: 1, 2, 3... over the floor(share * N / 100)
    rows of highest score among the N of least_words words or more, ties to smaller
    ids (null ids last, then by all columns); null for the others.

    No task sees all that is drawn. Counts by score, of which there are few, give the
    score where the draw ends and how many rows each score has above it. Only rows
    of that score and above are numbered, inside ranges of (score, id) that are as
    many as the shuffle's partitions, each from the counts of those before it.
    """
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    counts = rows.where(able).groupBy("score").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))  # a single row
    last = counts.withColumn("_upto", upto).join(F.broadcast(total), F.lit(True)).where(F.col("_upto") - F.col("_c") < F.floor(F.col("_n") * share / 100))
    cut, n = last.agg(F.min("score"), F.floor(F.max("_n") * share / 100)).first()
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.col(id_col).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in rows.columns if c not in ("score", id_col))]
    near = rows.where(able & (F.col("score") >= cut))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(near.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "draw")
    # As many rows as there are partitions.
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = dealt.join(before, "_part").withColumn("rank", (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("long"))
    drawn = numbered.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).select(*rows.columns, "rank")
    rest = rows.where(~F.coalesce(able & (F.col("score") >= cut), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs, all long:
    share percent of the documents of least_words words or more, drawn towards the
    target's distribution of word runs of 1 to n words.

    Null and empty texts have no features and weight 0; very long ones are read
    whole. A row with a null id takes part, with the noise of an empty id, after others of its
    score. Repeated rows each take part and tie with one another. Other columns are ignored. An empty
    docs gives an empty result; an empty target leaves the smoothing alone.
    """
    gain = gains(docs, target, n, buckets, text_col, target_col)
    key = unused(list(COLUMNS), "doc_id") if id_col in COLUMNS else id_col
    named = docs.select(F.col(id_col).alias(key), F.col(text_col).cast("string").alias("_text"))
    rows = weights(named, gain, n, key, "_text")
    scored = table(rows.withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    return ranked(scored, share, least_words, key)


def joined_by_space(words: Iterable[bytes]) -> int:
    """crc32 of words joined by one space, chained: what features_of() gives a run."""
    words = list(words)
    return reduce(lambda v, w: zlib.crc32(w, zlib.crc32(b" ", v)), words[1:], zlib.crc32(words[0]))


#: The same in SQL: crc32 by its table over the distinct words' bytes.
ORACLE = r"""
with recursive bits as (
  select i::bigint as i, 0 as k, i::bigint as c from range(256) t(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8
), crc_table as (select list(c order by i) as tab from bits where k = 8
), texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), cut as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), words as (select kind, id, unnest(w) as word from cut
), own as (select distinct word from words
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(hex(encode(word))), 2), lambda p: ('0x' || substr(hex(encode(word)), p::int, 2))::bigint)),
    lambda c, b: xor(tab[(xor(c, b) % 256)::int + 1], c // 256)), 4294967295::bigint) % 10000 as bucket from own, crc_table
), counts as (
  select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from words join hashed using (word) group by bucket
), gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts
), weighed as (
  select id, count(*) as n, sum(gain)::bigint as g from words join hashed using (word) join gain using (bucket) where kind = 'd' group by id
), scored as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(g / n), 0)::bigint as weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint + 0.5)::double / 4294967296::double)))::bigint as noise
  from documents left join weighed on doc_id = id
), placed as (
  select doc_id, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as able from scored where n_features >= 20
)
select doc_id, n_features, weight, weight + noise as score, case when place <= floor(10 * able / 100) then place end as rank
from scored left join placed using (doc_id)
"""
