"""Spelling variants: words one edit apart, found by shared single deletions, led to their commonest form.

Every word of the vocabulary emits itself and each distinct word that lacks one of its code points. Words
one edit apart share such a key, so an equi-join on keys finds them all; exact distance one is verified. A key's
group is bounded by the alphabet, not by the corpus: its words are it and it with one code point put in.
All of it is DataFrame functions; counts are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.runtime import Scratch, table

#: Runs that words are made from, as a regular expression.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many (document, run) is written with a deletion; fewest code points and occurrences of a word.
NOISE, MIN_LENGTH, MIN_COUNT = 97, 5, 3


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE) -> DataFrame:
    """``word``: a row for each run of letters in each text, A-Z lower-cased; with ``noise``, some lack a code point by the run's checksum."""
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    lowered = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(id_.alias("doc"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    if noise is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
    return runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words of enough code points that occur often enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: both directions of each pair of words (with counts ``n``) exactly one insertion, deletion or replacement apart."""
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    keys = words.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("key"))
    other = keys.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    close = (F.col("word") != F.col("near")) & (F.abs(F.length("word") - F.length("near")) <= 1)
    pairs = keys.join(other, "key").where(close).where(F.levenshtein("word", "near", 1) == 1)
    # Dealt by word: pairs that share several keys are told apart, and later sums a word need no other shuffle.
    return pairs.select("word", "n", "near", "near_n").repartition("word").dropDuplicates(["word", "near"])


def variants(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of a table ``word, n``.

    ``form`` is the near word that occurs most (of equals the first in code-point order) if it occurs at least twice
    as often as the word, else null; ``root`` is where following forms ends, the word itself if it has none. Counts at least double
    with every form, so chains are short, and following them doubles its stride. No words give no rows; null words are dropped, and a word may
    come in several rows (their counts are added).
    """
    # By their compressed columns these tables count as small; the hint keeps joins from building them whole on the driver.
    words = scratch.write(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words").hint("merge")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    formed = F.col("best.minus") * -1 >= F.col("n") * 2
    near = near.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n"))
    found = scratch.write(words.join(near, "word", "left").select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "forms").hint("merge")
    up = scratch.write(found.where("form is not null").select("word", F.col("form").alias("root")), "up")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        new = scratch.write(up.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "up")
        scratch.drop(up)
        up = new.select("word", "root")
        up._lodegraph_path = new._lodegraph_path
        if new.where("moved").isEmpty():
            break
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE) -> DataFrame:
    """`variants` of the words of whole texts.

    Null and empty texts hold no words; a null id counts as an empty one in checksums; rows with one id are each counted. Texts of any
    length are read whole, an empty table gives no rows, other columns are not read.
    """
    return variants(vocabulary(occurrences(docs, id_col, text_col, noise)), scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: words of documents with their forms and roots."""
    return group_spellings(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


#: The same in DuckDB. A checksum is the exclusive or of what each byte adds by its distance from the end, and of what the length alone gives.
ORACLE = rf"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents
), counted as (
  select coalesce(doc_id::varchar, '') || ':' || run as name, run, count(*) as n from runs group by all
), bytes as (
  select name, octet_length(encode(name)) as size, unnest(regexp_extract_all(hex(encode(name)), '..')) as x, unnest(range(octet_length(encode(name)))) as i from counted
), one as (
  select b, list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(b)
), adds as (
  select 0::bigint as k, b, c from one
  union all
  select k + 1, adds.b, xor(adds.c >> 8, one.c) from adds join one on one.b = adds.c & 255 where k < (select max(size) from bytes)
), empties as (
  select 0::bigint as k, 4294967295::bigint as s
  union all
  select k + 1, xor(s >> 8, c) from empties join one on b = s & 255 where k < (select max(size) from bytes)
), summed as (
  select name, any_value(size) as size, bit_xor(c) as c from bytes join adds on k = size - 1 - i and b = ('0x' || x)::bigint group by name
), spelled as (
  select run, n, xor(xor(c, s), 4294967295) % {NOISE} = 0 as cut, (xor(xor(c, s), 4294967295) % length(run))::int as place
  from counted join summed using (name) join empties on k = size
), words as (
  select case when cut then substr(run, 1, place) || substr(run, place + 2) else run end as word, sum(n)::bigint as n
  from spelled group by 1 having sum(n) >= {MIN_COUNT} and length(word) >= {MIN_LENGTH}
), less as (
  select word, n, i as place, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as key from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from less a join less b using (key, place) where a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from less a join words b on b.word = key
  union
  select a.word, a.n, b.word, b.n from words a join less b on a.word = key
), best as (
  select word, count(*) as n_near, min({{'m': -near_n, 'w': near}}) as b from near group by word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.m >= 2 * w.n then b.w end as form, case when -b.m >= 2 * w.n then -b.m end as form_n from words w left join best using (word)
), walk as (
  select word, word as root, form as nxt from forms
  union all
  select k.word, f.word, f.form from walk k join forms f on f.word = k.nxt
)
select word, form, root, n, n_near, form_n from forms join (select word, root from walk where nxt is null) using (word)
"""
