"""Queries for sentences, lengths, pages and ROUGE
(T12-T17, T22, P4-P7, A4, A13-A16, E1-E6, L9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as tx
from ..functions.numeric import r6
from ..operators import rouge as rg
from ..operators import summarize as sm
from ..sources.tables import read_table
from . import sqlfrag as q
from .registry import query

LEAD_SQL = (f"CASE WHEN length(regexp_extract({q.strip('text')}, '(?s)^(.*?[.!?])(\\s|$)', 1)) > 0 "
            f"THEN regexp_extract({q.strip('text')}, '(?s)^(.*?[.!?])(\\s|$)', 1) ELSE {q.strip('text')} END")
SENT_SQL = (f"list_filter(string_split(regexp_replace({q.strip('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: length(s) > 0)")


@query("lead_sentence", ops="T13 T17", sql=f"""
SELECT doc_id, {LEAD_SQL} AS lead FROM documents""")
def lead_sentence(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.lead_sentence(F.col("text")).alias("lead"))


@query("sentences", ops="T12", sql=f"""
SELECT doc_id, len({SENT_SQL}) AS n_sentences, array_to_string({SENT_SQL}, chr(10)) AS sentences FROM documents""")
def sentences(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"),
                    F.array_join("s", "\n").alias("sentences"))


LONG = f"{q.word_count('text')} > 30"


@query("length_cutoffs", ops="A4 P4", sql=f"""
WITH l AS (SELECT text, {LEAD_SQL} AS lead FROM documents WHERE {LONG})
SELECT CAST(floor(quantile_cont({q.word_count('text')}, 0.995)) AS BIGINT) AS max_text_length,
       CAST(floor(quantile_cont({q.word_count('lead')}, 0.995)) AS BIGINT) AS max_lead_length FROM l""")
def length_cutoffs(spark, sf):
    d = read_table(spark, sf, "documents")
    d = d.filter(tx.word_count(F.col("text")) > 30).select("text", tx.lead_sentence(F.col("text")).alias("lead"))
    return sm.length_cutoffs(d, ["text", "lead"])


@query("length_histogram", ops="A16 T22", sql=f"""
SELECT CAST(floor({q.word_count('text')} / 50) AS BIGINT) AS bucket,
       CAST(floor({q.word_count('text')} / 50) AS BIGINT) * 50 AS lo, count(*) AS n FROM documents GROUP BY 1, 2""")
def length_histogram(spark, sf):
    d = read_table(spark, sf, "documents").select(tx.word_count(F.col("text")).alias("n_words"))
    b = F.floor(F.col("n_words") / 50).cast("long")
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", (F.col("bucket") * 50).alias("lo"), "n")


def _title_sql(col: str) -> str:
    raw = f"regexp_extract({col}, '(?is)<title[^>]*>(.*?)</title', 1)"
    dec = raw
    for name in [n for n in H.COMMON_ENTITIES if n != "amp"] + ["amp"]:
        dec = f"replace({dec}, {q.lit('&' + name + ';')}, {q.lit(H.ENTITIES[name])})"
    return q.strip(dec)


@query("page_title", ops="S4 T17", sql=f"""
SELECT page_id, {_title_sql('html')} AS headline FROM pages""")
def page_title(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", H.extract_title(F.col("html")).alias("headline"))


@query("repair_url", ops="T16", sql="""
SELECT page_id, url,
       CASE WHEN strpos(substr(url, 2), 'http') > 0 THEN substr(url, strpos(substr(url, 2), 'http') + 1) ELSE url END AS repaired,
       substr(url, 31) AS prefix_cut FROM pages""")
def repair_url(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", H.repair_url(F.col("url")).alias("repaired"),
                    H.drop_prefix(F.col("url"), 30).alias("prefix_cut"))


@query("extract_body", ops="T14 T15 T5 P6 P7 D3", sql=None)
def extract_body(spark, sf):
    return sm.articles(read_table(spark, sf, "pages")).select("page_id", "headline", "body")


@query("drop_blocked", ops="T15", sql=None)
def drop_blocked(spark, sf):
    """Block-list with a term that occurs in the pages ('the') next to the default ones."""
    p = read_table(spark, sf, "pages")
    nodes = H.extract_nodes(F.col("html"))
    kept = H.drop_blocked(nodes, H.BLOCKED_TERMS + ["the"])
    return p.select("page_id", F.size(nodes).cast("long").alias("n_nodes"), F.size(kept).cast("long").alias("n_kept"))


PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, a.text AS prediction, u.text AS reference
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""


def conversation_pairs(spark, sf):
    """(conv_id, turn, prediction, reference): each user turn against the next
    assistant turn.  Joined on (conv_id, turn) so a long conversation does not
    concentrate in one task."""
    c = read_table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, on=["conv_id", "turn"], how="inner")


def _rouge_n_sql(n: int) -> str:
    def grams(t):
        if n == 1:
            return t
        return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"
    return f"""
WITH {PAIRS_SQL},
tok AS (SELECT conv_id, turn, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS pt,
               regexp_extract_all(lower(reference), '[a-z0-9]+') AS rt FROM pairs),
gr AS (SELECT conv_id, turn, {grams('pt')} AS pg, {grams('rt')} AS rg FROM tok),
g AS (SELECT conv_id, turn, unnest(pg) AS gram, 1 AS side FROM gr UNION ALL SELECT conv_id, turn, unnest(rg), 2 FROM gr),
c AS (SELECT conv_id, turn, gram, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cp,
             sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS cr FROM g GROUP BY ALL),
ov AS (SELECT conv_id, turn, sum(least(cp, cr)) AS overlap FROM c GROUP BY ALL),
s AS (SELECT gr.conv_id, gr.turn, coalesce(ov.overlap, 0) / greatest(len(pg), 1) AS p,
             coalesce(ov.overlap, 0) / greatest(len(rg), 1) AS r FROM gr LEFT JOIN ov USING (conv_id, turn)),
f AS (SELECT conv_id, turn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM s)"""


def _rn(spark, sf, n):
    r = rg.rouge_n(conversation_pairs(spark, sf), ["conv_id", "turn"], n=n)
    pre = f"rouge{n}"
    return r.select("conv_id", "turn", *[r6(f"{pre}_{m}").alias(f"{pre}_{m}")
                                         for m in ["precision", "recall", "fmeasure"]])


@query("rouge_1", ops="E1", sql=_rouge_n_sql(1) + """
SELECT conv_id, turn, round(1e-10 + p, 6) AS rouge1_precision, round(1e-10 + r, 6) AS rouge1_recall,
       round(1e-10 + f, 6) AS rouge1_fmeasure FROM f""")
def rouge_1(spark, sf):
    return _rn(spark, sf, 1)


@query("rouge_2", ops="E2", sql=_rouge_n_sql(2) + """
SELECT conv_id, turn, round(1e-10 + p, 6) AS rouge2_precision, round(1e-10 + r, 6) AS rouge2_recall,
       round(1e-10 + f, 6) AS rouge2_fmeasure FROM f""")
def rouge_2(spark, sf):
    return _rn(spark, sf, 2)


ROUGE_L_SQL = f"""
WITH {PAIRS_SQL},
tok AS (SELECT conv_id, turn, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS pt,
               regexp_extract_all(lower(reference), '[a-z0-9]+') AS rt FROM pairs),
m AS (SELECT *, list_prepend(list_transform(rt, lambda b: 0), list_transform(pt, lambda a: list_transform(rt, lambda b: CASE WHEN a = b THEN 1 ELSE 0 END))) AS steps
      FROM tok),
l AS (SELECT *, coalesce(list_max(list_reduce(steps, lambda row, hit: list_transform(
             [list_transform(range(1, len(row) + 1), lambda k: greatest(row[k], CASE WHEN hit[k] = 1 THEN 1 + (CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END) ELSE 0 END))],
             lambda best: list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j])))[1])), 0) AS lcs FROM m),
s AS (SELECT conv_id, turn, lcs / greatest(len(pt), 1) AS p, lcs / greatest(len(rt), 1) AS r FROM l)
SELECT conv_id, turn, round(1e-10 + p, 6) AS rougeL_precision, round(1e-10 + r, 6) AS rougeL_recall,
       round(1e-10 + CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS rougeL_fmeasure FROM s"""


@query("rouge_l", ops="E3", sql=ROUGE_L_SQL)
def rouge_l(spark, sf):
    r = rg.rouge_l(conversation_pairs(spark, sf), ["conv_id", "turn"])
    return r.select("conv_id", "turn", *[r6(c).alias(c) for c in
                                         ["rougeL_precision", "rougeL_recall", "rougeL_fmeasure"]])


@query("rouge_lsum", ops="E4", sql=None)
def rouge_lsum(spark, sf):
    p = conversation_pairs(spark, sf)
    lines = p.select("conv_id", "turn", *[tx.newline_sentences(F.col(c)).alias(c) for c in ("prediction", "reference")])
    r = rg.rouge_lsum(lines, ["conv_id", "turn"])
    return r.select("conv_id", "turn", *[r6(c).alias(c) for c in
                                         ["rougeLsum_precision", "rougeLsum_recall", "rougeLsum_fmeasure"]])


@query("rouge_corpus", ops="A13 A14 E1-E4", sql=None)
def rouge_corpus(spark, sf):
    s = rg.rouge_all(conversation_pairs(spark, sf), ["conv_id", "turn"])
    c = rg.rouge_corpus(s)
    return c.select("pairs", *[r6(x).alias(x) for x in ["rouge1", "rouge2", "rougeL", "rougeLsum"]])


@query("rouge_corpus_n", ops="A13 A14 E1 E2", sql=f"""
SELECT a.pairs, a.rouge1, b.rouge2 FROM
({_rouge_n_sql(1)} SELECT count(*) AS pairs, round(1e-10 + avg(f), 6) AS rouge1 FROM f) a CROSS JOIN
({_rouge_n_sql(2)} SELECT round(1e-10 + avg(f), 6) AS rouge2 FROM f) b""")
def rouge_corpus_n(spark, sf):
    pairs = conversation_pairs(spark, sf)
    keys = ["conv_id", "turn"]
    r1 = rg.rouge_n(pairs, keys, n=1).select(*keys, F.col("rouge1_fmeasure").alias("rouge1"))
    r2 = rg.rouge_n(pairs, keys, n=2).select(*keys, F.col("rouge2_fmeasure").alias("rouge2"))
    c = rg.rouge_corpus(r1.join(r2, keys), cols=("rouge1", "rouge2"))
    return c.select("pairs", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


BOOT = 1000


def _poisson_case(u: str) -> str:
    cdf = rg._poisson1_cdf()
    parts = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(cdf))
    return f"CASE {parts} ELSE {len(cdf)} END"


@query("rouge_bootstrap", ops="A15", sql=f"""
SELECT * FROM ({_rouge_n_sql(1)},
bs AS (SELECT conv_id || ':' || turn AS pair, f AS rouge1 FROM f),
rep AS (SELECT pair, rouge1, t.r FROM bs CROSS JOIN range({BOOT}) t(r)),
w AS (SELECT r, rouge1, {_poisson_case(q.uniform(['pair', 'r']))} AS w FROM rep),
m AS (SELECT r, sum(rouge1 * w) / nullif(sum(w), 0) AS m FROM w GROUP BY r)
SELECT 'rouge1' AS metric, round(1e-10 + quantile_cont(m, 0.025), 6) AS low, round(1e-10 + quantile_cont(m, 0.5), 6) AS mid,
       round(1e-10 + quantile_cont(m, 0.975), 6) AS high FROM m)""")
def rouge_bootstrap(spark, sf):
    r1 = rg.rouge_n(conversation_pairs(spark, sf), ["conv_id", "turn"], n=1)
    s = r1.select(F.concat_ws(":", "conv_id", "turn").alias("pair"), F.col("rouge1_fmeasure").alias("rouge1"))
    b = rg.rouge_bootstrap(s, "pair", cols=("rouge1",), n_samples=BOOT)
    return b.select("metric", *[r6(c).alias(c) for c in ["low", "mid", "high"]])


@query("summarize_lead", ops="L9 T13", sql=None)
def summarize_lead(spark, sf):
    arts = sm.articles(read_table(spark, sf, "pages"))
    return sm.summarize(arts, max_words=None)


@query("evaluate_baseline", ops="E6 A13 R3 P4", sql=None)
def evaluate_baseline(spark, sf):
    e = sm.evaluate_baseline(sm.articles(read_table(spark, sf, "pages")))
    return e.select("pairs", *[r6(x).alias(x) for x in ["rouge1", "rouge2", "rougeL", "rougeLsum"]])


@query("rouge_1_stemmed", ops="E5 E1", sql=None)
def rouge_1_stemmed(spark, sf):
    """ROUGE-1 over Porter stems."""
    keys = ["conv_id", "turn"]
    r = rg.rouge_n(rg.stemmed_pairs(conversation_pairs(spark, sf), keys), keys, n=1)
    return r.select(*keys, *[r6(f"rouge1_{m}").alias(f"rouge1_{m}") for m in ["precision", "recall", "fmeasure"]])


@query("summarize_extractive", ops="L9 T12", sql=f"""
WITH st AS (SELECT doc_id, {q.strip('text')} AS t FROM documents),
sp AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM st),
se AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM sp),
w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM se),
n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS n FROM w),
sc AS (SELECT doc_id, pos, avg(n) AS score FROM n GROUP BY doc_id, pos),
z AS (SELECT se.doc_id, se.pos, se.s, sc.score, {q.word_count('se.s')} AS len FROM se JOIN sc USING (doc_id, pos)),
b AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
t AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS t FROM b WHERE before < 10 GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(list_slice(list_filter(string_split_regex(t.t, '\\s+'), lambda x: x <> ''), 1, 40), ' '), '') AS summary
FROM documents d LEFT JOIN t USING (doc_id)""")
def summarize_extractive(spark, sf):
    return sm.extractive_summary(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 10, 40)
