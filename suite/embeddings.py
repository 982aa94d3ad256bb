"""Vector queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventgrove.functions import vectors as vec
from eventgrove.operators.embeddings import (
    Layer,
    combine_vectors,
    embedding_quality,
    feature_table,
    lookup_sense,
    masked_mean_by,
    normalize_vectors,
    predicate_vectors,
    project_vectors,
)
from eventgrove.operators.mentions import annotate
from eventgrove.operators.projection import apply_projection, fit_projection
from suite.base import CORPUS_SQL, FRAME_SQL, benchmark_lemmas, conversation_mentions, conversations, joined, query, table
from suite.salience import BENCH_SQL
from suite.spans import piece_counts

_DIMS = "(SELECT *, unnest(range(1, 65)) AS d FROM embeddings)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def dims(df, keys, vector):
    """One row per dimension, rounded."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "d1_masked_mean",
    f"""SELECT label, CAST(d - 1 AS INTEGER) AS dim,
       round(sum(CASE WHEN embedding[1] > 0 THEN CAST(embedding[d] AS DOUBLE) ELSE 0 END) / greatest(sum(CASE WHEN embedding[1] > 0 THEN 1.0::DOUBLE ELSE 0 END), 1e-9), 6) AS value
FROM {_DIMS} GROUP BY label, d""",
)
def d1_masked_mean(spark, sf_dir):
    masked = vectors(spark, sf_dir).withColumn("mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    return dims(masked_mean_by(masked, ["label"], "embedding", "mask"), ["label"], "embedding")


@query(
    "d1_masked_mean_in_row",
    """SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim,
       round((CASE WHEN embedding[1] > 0 THEN CAST(embedding[d] AS DOUBLE) ELSE 0 END + CAST(embedding[d + 32] AS DOUBLE)) / (CASE WHEN embedding[1] > 0 THEN 2.0::DOUBLE ELSE 1 END), 6) AS value
FROM (SELECT *, unnest(range(1, 33)) AS d FROM embeddings)""",
)
def d1_masked_mean_in_row(spark, sf_dir):
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    mask = F.array((F.get("embedding", F.lit(0)) > 0).cast("int"), F.lit(1))
    return dims(vectors(spark, sf_dir).select("vec_id", vec.masked_mean(halves, mask).alias("mean")), ["vec_id"], "mean")


@query(
    "d2_l2_normalize",
    f"""SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim,
       round(CAST(embedding[d] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS value
FROM {_DIMS}""",
)
def d2_l2_normalize(spark, sf_dir):
    return dims(normalize_vectors(vectors(spark, sf_dir), "embedding"), ["vec_id"], "embedding")


def hidden_states(spark, sf_dir):
    """Two-dimensional piece vectors: (length of the word, piece position), special pieces at both ends."""
    corpus = conversations(spark, sf_dir)
    none = F.array(F.lit(None).cast("int"))
    words = F.flatten(F.transform(piece_counts(F.col("tokens")), lambda n, i: F.array_repeat(i, n)))
    lengths = F.flatten(
        F.zip_with("tokens", piece_counts(F.col("tokens")), lambda t, n: F.array_repeat(F.length(t).cast("float"), n))
    )
    ends = F.array(F.lit(-1.0).cast("float"))
    return corpus.select(
        "sent_id",
        F.concat(none, words, none).alias("word_ids"),
        F.transform(F.concat(ends, lengths, ends), lambda x, i: F.array(x, i.cast("float"))).alias("hidden"),
    )


_HIDDEN_SQL = (
    FRAME_SQL
    + """,
cnt AS (SELECT sent_id, tok_idx, token, CAST(floor((length(token) + 4) / 5) AS BIGINT) AS n FROM tok),
cum AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY sent_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM cnt),
piece AS (SELECT sent_id, tok_idx, unnest(range(before + 1, before + n + 1)) AS pos, CAST(length(token) AS DOUBLE) AS x FROM cum)
"""
)


@query(
    "d3_pieces_by_word",
    f"""WITH {_HIDDEN_SQL}
SELECT sent_id, tok_idx AS word, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS pieces FROM piece GROUP BY sent_id, tok_idx""",
)
def d3_pieces_by_word(spark, sf_dir):
    lists = hidden_states(spark, sf_dir).select(
        "sent_id", F.posexplode(vec.pieces_by_word(F.col("word_ids"))).alias("word", "pieces")
    )
    return lists.select("sent_id", "word", joined("pieces").alias("pieces"))


@query(
    "d4_span_mean",
    f"""WITH {_HIDDEN_SQL}
SELECT f.sent_id, f.frame, round(avg(p.x), 6) AS mean_x, round(avg(CAST(p.pos AS DOUBLE)), 6) AS mean_pos
FROM frame f JOIN piece p ON p.sent_id = f.sent_id AND p.tok_idx = f.tok_idx GROUP BY f.sent_id, f.frame""",
)
def d4_span_mean(spark, sf_dir):
    rows = predicate_vectors(annotate(conversations(spark, sf_dir)), hidden_states(spark, sf_dir))
    at = lambda name, i: F.round(F.get(name, F.lit(i)), 6)
    return rows.select("sent_id", "frame", at("predicate_emb", 0).alias("mean_x"), at("predicate_emb", 1).alias("mean_pos"))


@query(
    "d5_argument_mean",
    f"""WITH {_HIDDEN_SQL}
SELECT f.sent_id, f.frame, round(avg(p.x), 6) AS mean_x, round(avg(CAST(p.pos AS DOUBLE)), 6) AS mean_pos, CAST(NULL AS DOUBLE) AS arg2_x,
       coalesce((SELECT string_agg(g.lemma, ' ' ORDER BY g.tok_idx) FROM tagged g WHERE g.sent_id = f.sent_id AND g.tok_idx BETWEEN f.tok_idx + 1 AND f.tok_idx + 2), '') AS arg1_lemma
FROM frame f LEFT JOIN piece p ON p.sent_id = f.sent_id AND p.tok_idx BETWEEN f.tok_idx + 1 AND f.tok_idx + 2
GROUP BY f.sent_id, f.frame, f.tok_idx""",
)
def d5_argument_mean(spark, sf_dir):
    rows = predicate_vectors(annotate(conversations(spark, sf_dir)), hidden_states(spark, sf_dir))
    at = lambda name, i: F.round(F.get(name, F.lit(i)), 6)
    return rows.select(
        "sent_id",
        "frame",
        at("arg1_emb", 0).alias("mean_x"),
        at("arg1_emb", 1).alias("mean_pos"),
        at("arg2_emb", 0).alias("arg2_x"),
        joined("arg1_lemma").alias("arg1_lemma"),
    )


@query(
    "d6_lookup_sense",
    f"""WITH {CORPUS_SQL}, {BENCH_SQL},
lem AS (SELECT DISTINCT lemma FROM known),
keyed AS (SELECT lemma, lemma || CASE length(lemma) % 3 WHEN 0 THEN '_v' WHEN 1 THEN '_n' ELSE '' END AS lemma_key FROM lem),
sense AS (SELECT lemma_key, '1' AS sense_id, length(lemma) AS value FROM keyed WHERE length(lemma) > 3 UNION ALL SELECT lemma_key, '2', -1 FROM keyed),
m AS (SELECT sent_id || '#' || tok_idx AS mention_id, kind, lemma, '1' AS sense_id FROM mention),
c AS (SELECT mention_id, sense_id, k.lemma_key, k.p FROM m, LATERAL (SELECT unnest([{{'lemma_key': m.lemma || '_v', 'p': 0}}, {{'lemma_key': m.lemma || '_n', 'p': 1}}, {{'lemma_key': m.lemma, 'p': 2}}], recursive := true)) k
      WHERE k.lemma_key IN (SELECT lemma_key FROM sense)),
b AS (SELECT mention_id, sense_id, arg_min(lemma_key, p) AS lemma_key FROM c GROUP BY ALL)
SELECT m.mention_id, m.kind, s.lemma_key, s.sense_id, CAST(s.value AS INTEGER) AS value FROM m LEFT JOIN (SELECT b.mention_id, sense.* FROM b JOIN sense USING (lemma_key, sense_id)) s USING (mention_id)""",
)
def d6_lookup_sense(spark, sf_dir):
    lemmas = benchmark_lemmas(spark, sf_dir).select("lemma").distinct()
    n = F.length("lemma")
    suffix = F.when(n % 3 == 0, "_v").when(n % 3 == 1, "_n").otherwise("")
    keyed = lemmas.withColumn("lemma_key", F.concat("lemma", suffix))
    senses = (
        keyed.where(n > 3).select("lemma_key", F.lit("1").alias("sense_id"), n.alias("value"))
        .unionByName(keyed.select("lemma_key", F.lit("2").alias("sense_id"), F.lit(-1).alias("value")))
    )
    mentions = conversation_mentions(spark, sf_dir)[1].select(
        F.concat_ws("#", "sent_id", "tok_idx").alias("mention_id"),
        "kind",
        F.when(F.col("kind") == "verb", "1.0").otherwise("1").alias("sense"),
        F.array("lemma").alias("lemmas"),
    )
    return lookup_sense(mentions, senses).select("mention_id", "kind", "lemma_key", "sense_id", "value")


def sources(spark, sf_dir):
    """Three nullable vectors per row; all are null where the first component is small."""
    first = F.get("embedding", F.lit(0))
    part = lambda at: F.slice("embedding", at, 16)
    return vectors(spark, sf_dir).select(
        "vec_id",
        F.when(first > 0, part(1)).alias("b_emb"),
        F.when(first > -0.1, part(17)).alias("a_emb"),
        F.when(first > 0.1, part(33)).alias("c_emb"),
        part(49).alias("sent_emb"),
    )


@query(
    "d7_combine_average",
    """SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, round(CASE
  WHEN embedding[1] > 0.1 THEN (CAST(embedding[d] AS DOUBLE) + embedding[d + 16] + embedding[d + 32]) / 3
  WHEN embedding[1] > 0 THEN (CAST(embedding[d] AS DOUBLE) + embedding[d + 16]) / 2
  WHEN embedding[1] > -0.1 THEN CAST(embedding[d + 16] AS DOUBLE)
  ELSE CAST(embedding[d + 48] AS DOUBLE) END, 6) AS value
FROM (SELECT *, unnest(range(1, 17)) AS d FROM embeddings)""",
)
def d7_combine_average(spark, sf_dir):
    combined = combine_vectors(sources(spark, sf_dir), ["b_emb", "a_emb", "c_emb"], fallback="sent_emb")
    return dims(combined, ["vec_id"], "features")


@query(
    "d7_combine_concat",
    """WITH v AS (SELECT vec_id, CASE
  WHEN embedding[1] > 0.1 THEN embedding[17:32] || embedding[1:16] || embedding[33:48]
  WHEN embedding[1] > 0 THEN embedding[17:32] || embedding[1:16]
  WHEN embedding[1] > -0.1 THEN embedding[17:32]
  ELSE embedding[49:64] END AS f FROM embeddings)
SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, round(CAST(f[d] AS DOUBLE), 6) AS value FROM (SELECT *, unnest(range(1, len(f) + 1)) AS d FROM v)""",
)
def d7_combine_concat(spark, sf_dir):
    combined = combine_vectors(sources(spark, sf_dir), ["b_emb", "a_emb", "c_emb"], "concat", fallback="sent_emb")
    return dims(combined, ["vec_id"], "features")


@query(
    "d8_feature_table",
    """SELECT row_number() OVER (ORDER BY embedding[1] <= 0, vec_id) - 1 AS id, CASE WHEN embedding[1] > 0 THEN 'verb' ELSE 'nom' END AS kind, vec_id AS source_idx
FROM embeddings""",
)
def d8_feature_table(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("source_idx"), F.col("embedding").alias("features"))
    is_verb = F.get("features", F.lit(0)) > 0
    return feature_table(rows.where(is_verb), rows.where(~is_verb)).select("id", "kind", "source_idx")


def demo_layers(widths=(64, 32, 8)):
    """Fixed small weights in place of a trained encoder."""
    layers = []
    for n_in, n_out in zip(widths, widths[1:]):
        grid = np.add.outer(np.arange(n_out) * n_in, np.arange(n_in)).astype(float)
        layers.append(
            Layer(np.cos(grid) / np.sqrt(n_in), np.sin(np.arange(n_out)), np.zeros(n_out), np.ones(n_out), np.ones(n_out), np.zeros(n_out))
        )
    return layers


def _layer_sql(source: str, n_in: int, n_out: int) -> str:
    """One layer as SQL: linear, leaky ReLU, batch norm with mean 0 and variance 1."""
    return f"""SELECT vec_id, o, CASE WHEN y > 0 THEN y ELSE 0.01 * y END / sqrt(1 + 1e-5) AS v FROM (
  SELECT vec_id, o, sum(v * cos(CAST(o * {n_in} + i AS DOUBLE)) / sqrt({n_in}.0)) + sin(CAST(o AS DOUBLE)) AS y
  FROM {source}, range({n_out}) t(o) GROUP BY vec_id, o)"""


@query(
    "d9_project_vectors",
    f"""WITH x AS (SELECT vec_id, d - 1 AS i, CAST(embedding[d] AS DOUBLE) AS v FROM {_DIMS}),
a AS ({_layer_sql("x", 64, 32)}), b AS (SELECT vec_id, o AS i, v FROM a), c AS ({_layer_sql("b", 32, 8)})
SELECT vec_id, CAST(o AS INTEGER) AS dim, round(v, 6) AS value FROM c""",
)
def d9_project_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("features"))
    return dims(project_vectors(rows, demo_layers()), ["vec_id"], "features")


_GAP = "sqrt(list_sum(list_transform(range(1, 17), lambda i: (CAST(embedding[i + {a}] AS DOUBLE) - embedding[i + {b}]) ** 2)))"


@query(
    "d10_embedding_quality",
    f"""WITH n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS norm FROM embeddings),
r AS (SELECT sum(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / norm - CAST(x AS DOUBLE)) ** 2))) / sum(len(embedding)) AS recon FROM n),
s AS (SELECT avg(greatest({_GAP.format(a=0, b=16)} - {_GAP.format(a=0, b=32)} + 1.0, 0)) AS sim FROM embeddings)
SELECT round(recon, 6) AS reconstruction, round(sim, 6) AS similarity, round(recon + 0.01 * sim, 6) AS loss FROM r, s""",
)
def d10_embedding_quality(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    pairs = rows.select(F.col("embedding").alias("input"), vec.l2_normalize(F.col("embedding")).alias("output"))
    part = lambda at: F.slice("embedding", at, 16)
    triplets = rows.select(part(1).alias("anchor"), part(17).alias("positive"), part(33).alias("negative"))
    quality = embedding_quality(pairs, triplets)
    return quality.select(*[F.round(c, 6).alias(c) for c in quality.columns])


@query(
    "d9_fitted_projection",
    # Axes of full width keep every distance: each vector's squared distance from the mean, and their sum over the axes.
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM x GROUP BY i)
SELECT vec_id AS id, round(sum((x - m) * (x - m)), 6) AS squared_distance FROM x JOIN m USING (i) GROUP BY vec_id""",
)
def d9_fitted_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    projected = apply_projection(rows, fit_projection(rows, 64, passes=2))
    squares = F.aggregate("features", F.lit(0.0), lambda total, x: total + x * x)
    return projected.select("id", F.round(squares, 6).alias("squared_distance"))


@query(
    "d9_fitted_variance",
    # The projected coordinates are centred and uncorrelated, and the first axis holds more than any column does.
    """SELECT 8 AS axes, true AS centred, true AS uncorrelated, true AS falling, true AS first_is_largest, count(*) AS rows FROM embeddings""",
)
def d9_fitted_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("features"))
    fitted = fit_projection(rows, 8, passes=20)
    own = table(spark, sf_dir, "embeddings").select([F.var_pop(F.get("embedding", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(64)])
    at = lambda i: F.get("features", F.lit(i))
    pairs = [(i, j) for i in range(8) for j in range(i)]
    checks = apply_projection(rows, fitted).agg(
        F.count(F.lit(1)).alias("rows"),
        F.greatest(*(F.abs(F.avg(at(i))) for i in range(8))).alias("offset"),
        F.greatest(*(F.abs(F.corr(at(i), at(j))) for i, j in pairs)).alias("shared"),
        F.array(*(F.var_pop(at(i)) for i in range(8))).alias("spread"),
    )
    largest = own.select(F.greatest(*(F.col(f"c{i}") for i in range(64))).alias("largest"))
    return checks.join(F.broadcast(largest), F.lit(True)).select(  # one row on either side
        F.size("spread").alias("axes"),
        (F.col("offset") < 1e-9).alias("centred"),
        (F.col("shared") < 1e-6).alias("uncorrelated"),
        (F.col("spread") == F.sort_array("spread", asc=False)).alias("falling"),
        (F.get("spread", F.lit(0)) >= F.col("largest") * (1 - 1e-6)).alias("first_is_largest"),
        "rows",
    )
