"""Queries for shuffles, splits, samples and batching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import r6

from ..functions import text as tx
from ..operators import prep, rank, split
from ..operators import vocab as vb
from ..sources.tables import read_table
from . import sqlfrag as q
from .registry import query
from .q_prep import LABELLED_SQL, _labelled

SEED = 42
MD5 = q.md5key("doc_id", SEED)
LONG_DOCS_SQL = f"(SELECT doc_id, text FROM documents WHERE {q.word_count('text')} > 30)"


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _long_docs(spark, sf):
    return prep.min_words(read_table(spark, sf, "documents"), "text", 30)


@query("shuffle_rank", ops="R1 W7 R11", sql=f"""
SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank,
       row_number() OVER (ORDER BY {MD5}, doc_id) - 1 AS ordinal FROM documents""")
def shuffle_rank(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.shuffle(d, "doc_id", SEED).withColumn("ordinal", F.col("rank") - 1)


FRACS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _fraction_case():
    parts = []
    for name, lo, hi in split.cumulative_bounds(FRACS):
        parts.append(f"WHEN rank > floor({_d(lo)} * n) AND rank <= floor({_d(hi)} * n) THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


@query("fraction_split", ops="R3 P11 P4", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank, count(*) OVER () AS n FROM {LONG_DOCS_SQL})
SELECT doc_id, rank, split FROM (SELECT doc_id, rank, {_fraction_case()} AS split FROM r) WHERE split IS NOT NULL""")
def fraction_split(spark, sf):
    return split.fraction_split(_long_docs(spark, sf).select("doc_id"), FRACS, "doc_id", SEED)


STRAT_SQL = f"""
d AS {LABELLED_SQL},
c AS (SELECT label, count(*) AS c FROM d GROUP BY label),
a AS (SELECT label, c, sum(c) OVER () AS n FROM c),
b AS (SELECT label, c, n, n - ceil(CAST('0.2' AS DOUBLE) * n) AS ntrain FROM a),
qq AS (SELECT label, c, ntrain, c * ntrain / n AS q, floor(c * ntrain / n) AS f FROM b),
rr AS (SELECT label, c, f, ntrain - sum(f) OVER () AS need,
              row_number() OVER (ORDER BY q - f DESC, label) AS ord FROM qq),
alloc AS (SELECT label, c - (f + CASE WHEN ord <= need THEN 1 ELSE 0 END) AS ntest FROM rr),
rk AS (SELECT doc_id, label, text, row_number() OVER (PARTITION BY label ORDER BY {MD5}, doc_id) AS crank FROM d),
s AS (SELECT rk.doc_id, rk.label, rk.text, CASE WHEN crank <= ntest THEN 'test' ELSE 'train' END AS split
      FROM rk JOIN alloc USING (label))"""


@query("stratified_split", ops="R2 U3", sql=f"""
WITH {STRAT_SQL}
SELECT doc_id, label, split FROM s""")
def stratified_split(spark, sf):
    return split.stratified_split(_labelled(spark, sf), "label", 0.2, "doc_id", SEED) \
        .select("doc_id", "label", "split")


@query("split_balance", ops="J7 T1-T5 R2 A1", sql=f"""
WITH {STRAT_SQL}
SELECT split, label, count(*) AS n, round(1e-10 + avg(len({q.clean_tokens('text')})), 6) AS mean_words
FROM s GROUP BY split, label""")
def split_balance(spark, sf):
    """Minimum slice: labelled documents -> cleaned tokens -> stratified split ->
    per split and class: rows and mean cleaned words."""
    df = _labelled(spark, sf)
    # words are counted before the split so the text never travels through its shuffles
    df = df.select("doc_id", "label", F.size(prep.clean_tokens(F.col("text"))).alias("n_words"))
    s = split.stratified_split(df, "label", 0.2, "doc_id", SEED)
    return (s.groupBy("split", "label")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_words"), 6).alias("mean_words")))


@query("random_split", ops="R4", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rank <= ceil({_d(0.1)} * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def random_split(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.random_split(d, 0.1, "doc_id", SEED).select("doc_id", "split")


@query("sample_exact", ops="R5", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, rank FROM r WHERE rank <= round_even({_d(0.2)} * n, 0)""")
def sample_exact(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split.sample_exact(d, 0.2, "doc_id", SEED).select("doc_id", "rank")


@query("sample_n", ops="R6 R7 R8", sql=f"""
SELECT doc_id, text FROM documents ORDER BY {MD5}, doc_id LIMIT 3""")
def sample_n(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return split.sample_n(d, 3, "doc_id", SEED)


def _strat_ctes(src: str, frac: float, seed: int, p: str) -> str:
    """Stratified hold-out over relation ``src(doc_id, label)``; result CTE ``{p}s``."""
    md5 = q.md5key("doc_id", seed)
    return f"""
{p}c AS (SELECT label, count(*) AS c FROM {src} GROUP BY label),
{p}a AS (SELECT label, c, sum(c) OVER () AS n FROM {p}c),
{p}b AS (SELECT label, c, n, n - ceil({_d(frac)} * n) AS ntrain FROM {p}a),
{p}q AS (SELECT label, c, ntrain, c * ntrain / n AS q, floor(c * ntrain / n) AS f FROM {p}b),
{p}r AS (SELECT label, c, f, ntrain - sum(f) OVER () AS need,
                row_number() OVER (ORDER BY q - f DESC, label) AS ord FROM {p}q),
{p}al AS (SELECT label, c - (f + CASE WHEN ord <= need THEN 1 ELSE 0 END) AS ntest FROM {p}r),
{p}rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5}, doc_id) AS crank FROM {src}),
{p}s AS (SELECT {p}rk.doc_id, {p}rk.label, CASE WHEN crank <= ntest THEN 'test' ELSE 'train' END AS split
         FROM {p}rk JOIN {p}al USING (label))"""


@query("nested_split", ops="R2 U3", sql=f"""
WITH d0 AS (SELECT doc_id, label FROM {LABELLED_SQL}),
{_strat_ctes('d0', 0.1, SEED, 'x')},
d1 AS (SELECT doc_id, label FROM xs WHERE split = 'train'),
{_strat_ctes('d1', 0.15, SEED + 1, 'y')}
SELECT doc_id, label, CASE WHEN split = 'test' THEN 'val' ELSE 'train' END AS split FROM ys
UNION ALL SELECT doc_id, label, 'test' AS split FROM xs WHERE split = 'test'""")
def nested_split(spark, sf):
    return split.nested_stratified_split(_labelled(spark, sf), "label", "doc_id").select("doc_id", "label", "split")


BATCH = 16
TOKS = q.basic_english("text")


@query("assign_batches", ops="W6 R1", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank FROM documents)
SELECT doc_id, CAST(floor((rank - 1) / {BATCH}) AS BIGINT) AS batch_id, (rank - 1) % {BATCH} AS pos_in_batch FROM r""")
def assign_batches(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return rank.assign_batches(d, "doc_id", BATCH, SEED).select("doc_id", "batch_id", "pos_in_batch")


BATCHED_SQL = f"""
r AS (SELECT doc_id, len({TOKS}) AS n_tokens, row_number() OVER (ORDER BY {MD5}, doc_id) AS rank FROM documents),
b AS (SELECT doc_id, n_tokens, rank, CAST(floor((rank - 1) / {BATCH}) AS BIGINT) AS batch_id FROM r)"""


def _batched(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.size(tx.basic_english(F.col("text"))).cast("long").alias("n_tokens"))
    return rank.assign_batches(d, "doc_id", BATCH, SEED)


@query("batch_offsets", ops="W1 D2", sql=f"""
WITH {BATCHED_SQL}
SELECT doc_id, batch_id, n_tokens,
       CAST(coalesce(sum(n_tokens) OVER (PARTITION BY batch_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM b""")
def batch_offsets(spark, sf):
    return rank.batch_offsets(_batched(spark, sf), "n_tokens").select("doc_id", "batch_id", "n_tokens", "offset")


@query("pad_batch", ops="T19 J2 W6", sql=f"""
WITH {BATCHED_SQL},
ids AS (SELECT b.doc_id, batch_id, n_tokens, list_transform({TOKS}, lambda w: CAST(length(w) AS BIGINT)) AS ids FROM b JOIN documents d ON d.doc_id = b.doc_id),
m AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS batch_len FROM ids)
SELECT doc_id, batch_id, n_tokens, batch_len,
       array_to_string(list_concat(ids, list_transform(range(batch_len - n_tokens), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(range(n_tokens), lambda x: 1), list_transform(range(batch_len - n_tokens), lambda x: 0)), ',') AS attention_mask
FROM m""")
def pad_batch(spark, sf):
    """Ids (here the token lengths) padded to the longest row of their batch, with the mask."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.transform(tx.basic_english(F.col("text")), lambda w: F.char_length(w).cast("long")).alias("ids"))
    p = vb.pad_batches(rank.assign_batches(d, "doc_id", BATCH, SEED))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return p.select("doc_id", "batch_id", F.size("ids").cast("long").alias("n_tokens"), "batch_len", text("input_ids"),
                    text("attention_mask"))


@query("batch_counts", ops="A19", sql=f"""
SELECT count(*) AS rows, CAST(ceil(count(*) / 16) AS BIGINT) AS batches,
       CAST(floor(count(*) / 16) AS BIGINT) AS log_interval, CAST(ceil(count(*) / 16) * 10 AS BIGINT) AS total_steps
FROM {LONG_DOCS_SQL}""")
def batch_counts(spark, sf):
    return split.batch_counts(_long_docs(spark, sf), 16, 10)


@query("row_slice", ops="P11 P2", sql="""
SELECT doc_id, source, position FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS position FROM documents)
WHERE position >= (SELECT count(*) FROM documents) // 4 AND position < (SELECT count(*) FROM documents) // 2""")
def row_slice(spark, sf):
    """The second quarter of the documents in (source, doc_id) order."""
    d = prep.drop_columns(read_table(spark, sf, "documents"), ["text", "lang", "n_chars"])
    n = d.count()
    return split.row_slice(d, n // 4, n // 2, [F.col("source").asc(), F.col("doc_id").asc()])


@query("keep_constant_complement", ops="P2 P6 U2", sql="""
SELECT doc_id, lang, 'short' AS kind FROM documents WHERE NOT coalesce(n_chars > 1000, false)""")
def keep_constant_complement(spark, sf):
    d = split.complement(read_table(spark, sf, "documents"), F.col("n_chars") > 1000)
    return prep.with_constant(prep.keep_columns(d, ["doc_id", "lang"]), "kind", "short")


@query("point_lookup", ops="P12 J6", sql="""
SELECT d.doc_id, d.text AS pair_text, l.quality AS pair_label FROM documents d JOIN labels l USING (doc_id)
WHERE d.doc_id = (SELECT min(doc_id) FROM labels)""")
def point_lookup(spark, sf):
    """One labelled row by its key, as a (text, label) pair."""
    labels = read_table(spark, sf, "labels")
    key = labels.agg(F.min("doc_id")).first()[0]
    one = prep.labelled(prep.row_at(read_table(spark, sf, "documents"), "doc_id", key), labels)
    return one.select("doc_id", prep.zip_pairs(one).alias("p")).select(
        "doc_id", F.col("p.text").alias("pair_text"), F.col("p.label").alias("pair_label"))


@query("longest_documents", ops="R8", sql="""
SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10""")
def longest_documents(spark, sf):
    """A top-k report: the ten longest documents."""
    return split.head(read_table(spark, sf, "documents").select("doc_id", "n_chars"), 10,
                      [F.col("n_chars").desc(), F.col("doc_id").asc()])


@query("split_overlap", ops="U3", sql="""
SELECT lang AS key, count(DISTINCT source) AS n_splits FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1""")
def split_overlap(spark, sf):
    """Languages that sit in more than one source."""
    d = read_table(spark, sf, "documents").select(F.col("lang").alias("key"), "source")
    return split.overlapping_keys(d, "key", "source")
