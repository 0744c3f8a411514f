"""Registered queries of the training-data operators: thin digests over the operators' own results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bm25, collocations, filter_audit, quality_rules, segments
from .mixing import mix
from .nbsvm import fit
from .ngram_join import jaccard_classes
from .nn_descent import near_classes
from .pieces import encode_decode
from .reshard import reshard
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens

# words: runs of anything but the six ASCII white-space characters
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def held_out(id_col: str = "doc_id"):
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str):
    """Fitted on the labelled documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    docs = table(spark, sf_dir, "documents").where(~held_out())
    return fit(docs, labels.select("doc_id", "quality"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select(
        "doc_id", held_out().alias("held_out"), quality_model(spark, sf_dir).score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 20, whole, against all documents."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, asked, 10, query_text="text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=())


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the rules' spans; ``spans`` also has those that the segment model adds."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", segments.spans(F.col("text"), segments.fit(docs)).alias("s"))

    def joined(only_rule: bool):
        kept = F.filter("s", lambda x: x["rule"]) if only_rule else F.col("s")
        return F.array_join(F.transform(kept, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("s", lambda x: x["rule"] & (x["kind"] == kind))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in segments.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"),
                        F.size(F.filter("s", lambda x: ~x["rule"])).cast("long").alias("n_added"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                         outputs=("ids_sha256", "decoded_sha256", "span_bytes"))


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes from six shards that a hash of the text filled."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.hash(F.coalesce("text", F.lit(""))), F.lit(6))
    return reshard(docs, old, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn(
        "failed", F.array_join("failed", ","))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_quality, op2_bm25, op3_ngram_join, op4_token_counts, op5_suffix_dedup, op6_private,
                                op7_pieces, op8_reshard, op9_mixing,
                                op10_embedding_dedup, op11_quality_rules, op12_collocations,
                                op13_filter_audit)}
# SQL of the operators; DuckDB reads it
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {"op2_bm25": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
q AS (SELECT doc_id AS query_id, unnest({_TERMS}) AS t FROM documents WHERE doc_id % 20 = 0),
qt AS (SELECT query_id, t, count(*) AS times FROM q GROUP BY query_id, t),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d),
tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM qt) GROUP BY doc_id, dl, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (SELECT qt.query_id, tf.doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM qt JOIN tf ON qt.t = tf.t JOIN df ON qt.t = df.t CROSS JOIN s GROUP BY qt.query_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op11_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
li AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, w[i:i + 7] AS ws FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ws) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
    (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN li ON d.r = li.r LEFT JOIN rep ON d.r = rep.r),
m AS (SELECT r, lang, source, unnest([
        {'k': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1), 'slack': 50},
        {'k': 'capitals', 'v': 1000 * n_capitals // greatest(word_chars, 1), 'slack': 150},
        {'k': 'word_length', 'v': 100 * word_chars // greatest(n_words, 1), 'slack': 100},
        {'k': 'repeat_words', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'slack': 200},
        {'k': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'slack': 300}]) AS s FROM f),
v AS (SELECT r, lang, source, s.k AS k, s.v AS v, s.slack AS slack, greatest(length(bin(s.v)) - 6, 0) AS e FROM m),
top AS (SELECT r, lang, source, k, v, slack, (((v >> e) + 1) << e) - 1 AS t FROM v),
lv AS (SELECT 0 AS lv, lang, source, k, t FROM top UNION ALL SELECT 1, lang, NULL, k, t FROM top
    UNION ALL SELECT 2, NULL, NULL, k, t FROM top),
qs AS (SELECT lv, lang, source, k, count(*) AS rows, quantile_disc(t, 0.25) AS a, quantile_disc(t, 0.75) AS b FROM lv GROUP BY ALL),
lim AS (SELECT o.lang, o.source, o.k, CASE WHEN o.rows >= 100 THEN o.a WHEN g.rows >= 100 THEN g.a ELSE x.a END AS a,
        CASE WHEN o.rows >= 100 THEN o.b WHEN g.rows >= 100 THEN g.b ELSE x.b END AS b
    FROM qs o JOIN qs g ON o.lv = 0 AND g.lv = 1 AND o.k = g.k AND o.lang IS NOT DISTINCT FROM g.lang
    JOIN qs x ON x.lv = 2 AND x.k = o.k),
bad AS (SELECT r, string_agg(top.k, ',' ORDER BY list_position(['symbols', 'capitals', 'word_length', 'repeat_words', 'dup_lines'], top.k)) AS failed
    FROM top JOIN lim ON top.k = lim.k AND top.lang IS NOT DISTINCT FROM lim.lang AND top.source IS NOT DISTINCT FROM lim.source
    WHERE v > b + 6 * (b - a) + slack OR (top.k = 'word_length' AND v < a - 6 * (b - a) - slack) GROUP BY r),
o AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed,
    NOT base_failed AND failed IS NULL AS kept FROM o LEFT JOIN bad ON o.r = bad.r""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lb AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f FROM d LEFT JOIN lb ON d.doc_id = lb.doc_id),
c AS (SELECT part, f, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM m GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, n, g, x, f, list_transform(o, lambda k: f[ascii(k) - 64]) AS ff FROM c, o),
p AS (SELECT *, coalesce(list_position(ff, true), 6) AS goes, unnest([1, 2, 3, 4, 5]) AS step FROM s),
r AS (SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INT) AS step, o[step] AS k,
    sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN ff[step] AND goes < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN ff[step] AND len(list_filter(ff, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN goes = step THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN goes = step THEN x ELSE 0 END) AS toxic_lost
    FROM p GROUP BY part, o, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r""",
    "op12_collocations": r"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pc),
g AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k:
        list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM w) GROUP BY lang, p HAVING count(*) >= 30),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM g WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
    FROM c JOIN g x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
lo AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, len(p)), lambda k:
        list_transform(range(1, len(p) - k + 2), lambda i: p[i:i + k - 1])))) AS q FROM g WHERE len(p) > 2) GROUP BY lang, q),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN lo ON lo.lang = b.lang AND lo.q = b.p
    WHERE lo.f IS NULL OR 100 * CAST(lo.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT rk.lang, rank, phrase, a, l, r, n, score FROM rk JOIN tot ON tot.lang = rk.lang WHERE rank <= 2000"""}
