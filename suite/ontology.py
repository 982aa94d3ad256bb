"""Tree, prompt and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgrove.functions.tokens import default_lemma, token_form
from eventgrove.functions.let import unpacked
from eventgrove.operators.hierarchies import hierarchy_paths, split_label
from eventgrove.operators.linkage import merge_pairs, ward_linkage
from eventgrove.operators.mentions import annotate
from eventgrove.operators.naming import (
    attach_event_types,
    event_coverage,
    name_nodes,
    path_names,
    softmax,
    token_distribution,
    top_tokens,
)
from eventgrove.operators.prompts import (
    Limits,
    build_prompts,
    demonstrations,
    flatten_ace,
    flatten_maven,
    flatten_rams,
    locate_triggers,
    prompt_rows,
    sample_demonstrations,
    truncation_rate,
)
from eventgrove.operators.tree import (
    linkage_to_edges,
    node_depth,
    node_height,
    renumber_tree,
    rollup_distribution,
    rollup_son,
    root_path,
    tree_check,
    tree_closure,
    tree_intervals,
)
from eventgrove.plans.scratch import freeze, scratch_path
from eventgrove.sources.corpus import read_event_types, write_event_types
from suite.base import CORPUS_SQL, FRAME_SQL, conversation_mentions, conversations, joined, query, table
from suite.shapes import ace_shape, maven_shape, rams_shape
from suite.trees import GEO_SQL, geography


def embedding_features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query("e1_ward_linkage")
def e1_ward_linkage(spark, sf_dir):
    merges = ward_linkage(embedding_features(spark, sf_dir))
    return merges.withColumn("height", F.round("height", 6))


@query(
    "e1_ward_squares",
    # A merge at height h adds h * h / 2 to the squares within clusters, so all merges add up to those around the mean.
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM x GROUP BY i)
SELECT count(DISTINCT vec_id) - 1 AS merges, max(vec_id) + 1 AS largest, round(sum((x - m) * (x - m)), 4) AS squares FROM x JOIN m USING (i)""",
)
def e1_ward_squares(spark, sf_dir):
    merges = ward_linkage(embedding_features(spark, sf_dir))
    return merges.agg(
        F.count(F.lit(1)).alias("merges"), F.max("size").alias("largest"), F.round(F.sum(F.col("height") * F.col("height") / 2), 4).alias("squares")
    )


@query(
    "e1_ward_copies",
    # Copies merge at height 0, whatever the shape of their subtree.
    """SELECT CAST(0 AS DOUBLE) AS height, (SELECT count(*) FROM customer) - count(DISTINCT c_nationkey) AS merges FROM customer
UNION ALL
SELECT 1.0, count(DISTINCT c_nationkey) - 1 FROM customer""",
)
def e1_ward_copies(spark, sf_dir):
    # 25 places hold all customers: every vector is repeated many times.
    places = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey").cast("double") * F.col("c_nationkey")).alias("features")
    )
    merges = ward_linkage(places, tail_rows=4)
    return merges.groupBy((F.col("height") > 0).cast("double").alias("height")).agg(F.count(F.lit(1)).alias("merges"))


@query(
    "e2_merge_pairs",
    """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) ** 2))) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT a, arg_min(b, d) AS b, min(d) AS d FROM d GROUP BY a)
SELECT x.a AS "left", x.b AS "right", round(x.d, 6) AS distance FROM n x JOIN n y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b""",
)
def e2_merge_pairs(spark, sf_dir):
    state = embedding_features(spark, sf_dir).select(
        F.col("id").alias("cluster"), F.lit(1).cast("bigint").alias("size"), F.col("features").cast("array<double>").alias("centroid")
    )
    return merge_pairs(state).withColumn("distance", F.round("distance", 6))


@query(
    "e3_linkage_to_edges",
    """WITH n AS (SELECT count(*) AS n FROM customer)
SELECT c_custkey AS child, CASE WHEN c_custkey = 0 THEN n ELSE n + c_custkey - 1 END AS parent, c_nationkey AS label FROM customer, n
UNION ALL
SELECT n + c_custkey AS child, CASE WHEN c_custkey = n - 2 THEN NULL ELSE n + c_custkey + 1 END, NULL FROM customer, n WHERE c_custkey < n - 1""",
)
def e3_linkage_to_edges(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    n = customer.count()
    # A chain: merge k joins customer k + 1 to what was merged before.
    key = F.col("c_custkey")
    merges = customer.where(key < n - 1).select(
        (key + n).alias("merge"), F.when(key == 0, F.lit(0)).otherwise(key + n - 1).alias("left"), (key + 1).alias("right")
    )
    return linkage_to_edges(merges, customer.select(key.alias("child"), F.col("c_nationkey").alias("label")))


@query(
    "e4_renumber_tree",
    f"""WITH {GEO_SQL},
inner_nodes AS (SELECT child AS node, parent IS NULL AS is_root FROM geo WHERE child IN (SELECT parent FROM geo WHERE parent IS NOT NULL)),
leaf AS (SELECT count(*) AS n FROM geo WHERE child NOT IN (SELECT node FROM inner_nodes)),
ids AS (SELECT node, row_number() OVER (ORDER BY is_root, node) - 1 + n AS id FROM inner_nodes, leaf)
SELECT coalesce(a.id, child) AS child, b.id AS parent, CAST(label AS INTEGER) AS label FROM geo LEFT JOIN ids a ON a.node = child LEFT JOIN ids b ON b.node = parent""",
)
def e4_renumber_tree(spark, sf_dir):
    return renumber_tree(geography(spark, sf_dir))


@query(
    "e5_tree_check",
    # Nations without customers are leaves too, and one leaf id too many is asked for.
    f"""WITH {GEO_SQL},
leaf AS (SELECT child AS node FROM geo WHERE child NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL)),
want AS (SELECT unnest(range(n + 1)) AS node FROM size)
SELECT 'leaf outside 0..n-1' AS "check", node FROM leaf WHERE node NOT IN (SELECT node FROM want)
UNION ALL SELECT 'leaf missing', node FROM want WHERE node NOT IN (SELECT node FROM leaf)""",
)
def e5_tree_check(spark, sf_dir):
    return tree_check(geography(spark, sf_dir), table(spark, sf_dir, "customer").count() + 1)


_CLOSURE_SQL = f"""WITH RECURSIVE {GEO_SQL},
up AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM geo
       UNION ALL SELECT u.node, g.parent, u.distance + 1 FROM up u JOIN geo g ON g.child = u.ancestor WHERE g.parent IS NOT NULL)
"""


@query("e6_tree_closure", f"{_CLOSURE_SQL} SELECT node, ancestor, distance FROM up")
def e6_tree_closure(spark, sf_dir):
    return tree_closure(geography(spark, sf_dir))


@query("e7_node_depth", f"{_CLOSURE_SQL} SELECT node, max(distance) AS depth FROM up GROUP BY node")
def e7_node_depth(spark, sf_dir):
    return node_depth(geography(spark, sf_dir))


@query(
    "e6_tree_intervals",
    # Zero-padded ids sort like numbers, so the order of the paths is the pre-order.
    f"""{_CLOSURE_SQL},
path AS (SELECT node, max(distance) AS depth, string_agg(printf('%012d', ancestor), '>' ORDER BY distance DESC) AS path FROM up GROUP BY node),
placed AS (SELECT node, depth, row_number() OVER (ORDER BY path) - 1 AS first FROM path),
sizes AS (SELECT ancestor AS node, count(*) AS size FROM up GROUP BY ancestor)
SELECT node, depth, first, first + size AS last FROM placed JOIN sizes USING (node)""",
)
def e6_tree_intervals(spark, sf_dir):
    return tree_intervals(geography(spark, sf_dir))


@query(
    "e10_node_height",
    f"""{_CLOSURE_SQL},
leaf AS (SELECT child AS node FROM geo WHERE child NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL))
SELECT ancestor AS node, max(distance) AS height FROM up JOIN leaf USING (node) GROUP BY ancestor""",
)
def e10_node_height(spark, sf_dir):
    return node_height(geography(spark, sf_dir))


@query(
    "e8_root_path",
    f"{_CLOSURE_SQL} SELECT node, string_agg(CAST(ancestor AS VARCHAR), '>' ORDER BY distance DESC) AS path FROM up GROUP BY node",
)
def e8_root_path(spark, sf_dir):
    return root_path(geography(spark, sf_dir)).select("node", joined("path", ">").alias("path"))


def leaf_distribution(spark, sf_dir):
    """Shares of the order priorities of each customer."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("token"))
    counts = freeze(orders.agg(F.count(F.lit(1)).alias("n")), "orders")
    totals = counts.groupBy("node").agg(F.sum("n").alias("total"))
    return counts.join(totals, "node").select("node", "token", (F.col("n") / F.col("total")).alias("prob"))


_DIST_SQL = """,
n_orders AS (SELECT o_custkey AS node, o_orderpriority AS token, count(*) AS n FROM orders GROUP BY ALL),
dist AS (SELECT node, token, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY node) AS prob FROM n_orders)
"""


@query(
    "e9_rollup_distribution",
    f"""{_CLOSURE_SQL}{_DIST_SQL},
leaf AS (SELECT child AS node FROM geo WHERE child NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL)),
above AS (SELECT u.* FROM up u JOIN leaf USING (node)),
n_leaves AS (SELECT ancestor, count(*) AS n FROM above GROUP BY ancestor)
SELECT a.ancestor AS node, d.token, round(sum(d.prob) / any_value(l.n), 6) AS prob
FROM dist d JOIN above a USING (node) JOIN n_leaves l ON l.ancestor = a.ancestor GROUP BY a.ancestor, d.token""",
)
def e9_rollup_distribution(spark, sf_dir):
    rolled = rollup_distribution(leaf_distribution(spark, sf_dir), geography(spark, sf_dir))
    return rolled.withColumn("prob", F.round("prob", 6))


@query(
    "e10_rollup_son",
    # Dense over the five priorities; 95 further tokens of the vocabulary never occur.
    f"""WITH {GEO_SQL}{_DIST_SQL},
vocab AS (SELECT DISTINCT o_orderpriority AS token FROM orders UNION ALL SELECT NULL),
leaf AS (SELECT child AS node, parent FROM geo WHERE child NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL)),
v0 AS (SELECT l.node, l.parent, v.token, coalesce(d.prob, 0) AS prob FROM leaf l, vocab v LEFT JOIN dist d ON d.node = l.node AND d.token = v.token),
m1 AS (SELECT parent AS node, token, exp(avg(prob)) AS w FROM v0 GROUP BY ALL),
v1 AS (SELECT node, token, w / sum(CASE WHEN token IS NULL THEN w * 95 ELSE w END) OVER (PARTITION BY node) AS prob FROM m1),
m2 AS (SELECT g.parent AS node, token, exp(avg(prob)) AS w FROM v1 JOIN geo g ON g.child = v1.node GROUP BY ALL),
v2 AS (SELECT node, token, w / sum(CASE WHEN token IS NULL THEN w * 95 ELSE w END) OVER (PARTITION BY node) AS prob FROM m2),
m3 AS (SELECT g.parent AS node, token, exp(avg(prob)) AS w FROM v2 JOIN geo g ON g.child = v2.node GROUP BY ALL),
v3 AS (SELECT node, token, w / sum(CASE WHEN token IS NULL THEN w * 95 ELSE w END) OVER (PARTITION BY node) AS prob FROM m3)
SELECT node, token, round(prob, 6) AS prob FROM v1 UNION ALL SELECT node, token, round(prob, 6) FROM v2 UNION ALL SELECT node, token, round(prob, 6) FROM v3""",
)
def e10_rollup_son(spark, sf_dir):
    edges = geography(spark, sf_dir)
    size = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().count() + 95
    values, absent = rollup_son(leaf_distribution(spark, sf_dir), edges, size)
    inner = edges.select(F.col("parent").alias("node")).where("node is not null").distinct()
    rows = values.unionByName(absent.select("node", F.lit(None).cast("string").alias("token"), F.col("absent").alias("prob")))
    return rows.join(inner, "node", "left_semi").withColumn("prob", F.round("prob", 6)).select("node", "token", "prob")


@query(
    "f2_split_label",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '>' || p_type ELSE p_brand || '>n/a>' || p_type END AS path FROM part""",
)
def f2_split_label(spark, sf_dir):
    # Only the trailing n/a goes.
    label = F.when(F.col("p_size") > 25, F.concat_ws(".", "p_brand", "p_type", F.lit("n/a"))).otherwise(
        F.concat_ws(".", "p_brand", F.lit("n/a"), "p_type")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return split_label(rows, "label", "rams").select("p_partkey", joined("path", ">").alias("path"))


@query(
    "f2_hierarchy_paths",
    """SELECT n_name AS label, r_name || '>' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, r_name FROM region""",
)
def f2_hierarchy_paths(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").alias("ord"))
        .unionByName(region.select(F.lit("World").alias("parent"), F.col("r_name").alias("child"), F.col("r_regionkey").alias("ord")))
    )
    return hierarchy_paths(edges).select("label", joined("path", ">").alias("path"))


@query(
    "f3_flatten_maven",
    f"WITH {CORPUS_SQL} SELECT DISTINCT sentence, kind AS event_type, token AS trigger FROM mention JOIN corpus USING (sent_id)",
)
def f3_flatten_maven(spark, sf_dir):
    return flatten_maven(maven_shape(conversations(spark, sf_dir)))


@query(
    "f4_flatten_rams",
    f"""WITH {CORPUS_SQL}
SELECT array_to_string(tokens, ' ') AS sentence, 'event.' || kind || '.n/a' AS event_type, token AS trigger FROM mention JOIN corpus USING (sent_id)""",
)
def f4_flatten_rams(spark, sf_dir):
    return flatten_rams(rams_shape(conversations(spark, sf_dir)))


@query("f4_locate_triggers", f"WITH {CORPUS_SQL} SELECT doc_id, sent_id, tok_idx AS local_index, doc_tok_idx AS trigger_start FROM placed")
def f4_locate_triggers(spark, sf_dir):
    from eventgrove.operators.mentions import sentence_offsets

    annotated, mentions = conversation_mentions(spark, sf_dir)
    offsets = sentence_offsets(annotated).select(
        "doc_id", "sent_id", F.col("sent_offset").alias("start"), (F.col("sent_offset") + F.col("n_tokens")).alias("end")
    )
    triggers = mentions.select("doc_id", F.col("doc_tok_idx").alias("trigger_start"))
    return locate_triggers(triggers, offsets, "doc_id").select(
        "doc_id", "sent_id", F.col("local_index").cast("int").alias("local_index"), "trigger_start"
    )


@query(
    "f5_demonstrations",
    f"WITH {CORPUS_SQL} SELECT sentence AS input, kind AS output, token AS predicate FROM mention JOIN corpus USING (sent_id)",
)
def f5_demonstrations(spark, sf_dir):
    return demonstrations(flatten_ace(ace_shape(conversations(spark, sf_dir))), "ace2005")


@query(
    "f6_prompt_rows",
    f"""WITH {FRAME_SQL}
SELECT f.sent_id || '#' || f.frame AS target_id, array_to_string(c.tokens, ' ') AS input, f.lemma AS predicate FROM frame f JOIN corpus c USING (sent_id)""",
)
def f6_prompt_rows(spark, sf_dir):
    return prompt_rows(annotate(conversations(spark, sf_dir)))


def _targets_and_demos(spark, sf_dir):
    corpus = conversations(spark, sf_dir)
    return prompt_rows(annotate(corpus)), demonstrations(flatten_ace(ace_shape(corpus)), "ace2005")


@query(
    "f7_sample_demonstrations",
    f"""WITH {FRAME_SQL},
demo AS (SELECT sentence AS input, kind AS output, token AS predicate, row_number() OVER (ORDER BY sentence, kind, token) - 1 AS place FROM mention JOIN corpus USING (sent_id)),
target AS (SELECT sent_id || '#' || frame AS target_id, unnest(range(8)) AS draw FROM frame),
drawn AS (SELECT target_id, CAST(draw AS INTEGER) AS draw, ('0x' || substr(md5(concat_ws('|', '42', target_id, draw)), 1, 13))::BIGINT % (SELECT count(*) FROM demo) AS place FROM target)
SELECT target_id, draw, input, output, predicate FROM drawn JOIN demo USING (place)""",
)
def f7_sample_demonstrations(spark, sf_dir):
    return sample_demonstrations(*_targets_and_demos(spark, sf_dir), k=8, seed=42)


@query(
    "f7_sample_properties",
    f"WITH {FRAME_SQL} SELECT sent_id || '#' || frame AS target_id, CAST(8 AS BIGINT) AS draws, true AS known FROM frame",
)
def f7_sample_properties(spark, sf_dir):
    targets, demos = _targets_and_demos(spark, sf_dir)
    sampled = sample_demonstrations(targets, demos, k=8, seed=42)
    known = demos.select("input", "output", "predicate", F.lit(True).alias("known")).distinct()
    return sampled.join(known, ["input", "output", "predicate"], "left").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("draws"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known")
    )


_PROMPT_SQL = (
    FRAME_SQL
    + r""",
target AS (SELECT f.sent_id || '#' || f.frame AS target_id, f.kind, f.lemma AS predicate, c.tokens AS words FROM frame f JOIN corpus c USING (sent_id)),
own AS (SELECT target_id, kind, ['sentence:'] || words || ['predicate:', predicate] AS own FROM target),
demo0 AS (SELECT target_id, words || ['predicate:', predicate] AS body, 'first' AS answer FROM target),
demo1 AS (SELECT target_id, ['sentence:'] || words || ['predicate:', predicate] AS body, kind AS answer FROM target),
whole AS (
  SELECT o.target_id, o.own, a.body[1:60 - 2 - 3] || ['event', 'type:', a.answer] || b.body[1:60 - 2 - 3] || ['event', 'type:', b.answer] || o.own[1:60 - 3] AS body
  FROM own o JOIN demo0 a USING (target_id) JOIN demo1 b USING (target_id))
SELECT target_id, array_to_string(body[greatest(len(body) - (100 - 2), 0) + 1:] || ['event', 'type:'], ' ') AS prompt, len(own) >= 60 - 3 AS truncated FROM whole
"""
)


def _prompts(spark, sf_dir):
    """Each target with two demonstrations made of itself, so that SQL can say the same."""
    corpus = conversations(spark, sf_dir)
    frames = annotate(corpus)
    targets = prompt_rows(frames)
    kinds = unpacked(frames, ["sent_id"], "frames", "frame", "f").select(
        F.concat_ws("#", "sent_id", "frame").alias("target_id"), F.col("f.kind").alias("kind")
    )
    base = targets.join(kinds, "target_id")
    drawn = base.select(
        "target_id",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("draw"),
        "input",
        "predicate",
        "kind",
    ).withColumn("output", F.when(F.col("draw") == 0, "first").otherwise(F.col("kind")))
    return build_prompts(targets, drawn, limits=Limits(per_example=60, whole=100))


@query("f8_build_prompts", f"WITH {_PROMPT_SQL}")
def f8_build_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir)


@query(
    "f8_truncation_rate",
    f"WITH {FRAME_SQL} SELECT round(avg(CASE WHEN n_tokens + 3 >= 60 - 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS truncation_rate FROM mention",
)
def f8_truncation_rate(spark, sf_dir):
    return truncation_rate(_prompts(spark, sf_dir)).select(F.round("truncation_rate", 6).alias("truncation_rate"))


def lemma_rows(corpus):
    """(sent_id, lemma) of every token."""
    return corpus.select("sent_id", F.explode("tokens").alias("t")).select(
        "sent_id", default_lemma(token_form(F.col("t"))).alias("lemma")
    )


_TOKEN_DIST_SQL = (
    CORPUS_SQL
    + """,
leaf AS (SELECT *, row_number() OVER (ORDER BY sent_id, tok_idx) - 1 AS node FROM mention),
share AS (SELECT sent_id, lemma AS token, count(*) / CAST(sum(count(*)) OVER (PARTITION BY sent_id) AS DOUBLE) AS prob FROM tagged GROUP BY sent_id, lemma),
token_dist AS (SELECT l.node, s.token, s.prob FROM leaf l JOIN share s USING (sent_id))
"""
)


def mention_nodes(spark, sf_dir):
    from eventgrove.plans.ordering import dense_index

    mentions = conversation_mentions(spark, sf_dir)[1]
    return dense_index(mentions.select("sent_id", "tok_idx", "kind", "lemma"), [F.col("sent_id"), F.col("tok_idx")], "node")


@query("f9_token_distribution", f"WITH {_TOKEN_DIST_SQL} SELECT node, token, round(prob, 6) AS prob FROM token_dist")
def f9_token_distribution(spark, sf_dir):
    dist = token_distribution(mention_nodes(spark, sf_dir), lemma_rows(conversations(spark, sf_dir)))
    return dist.withColumn("prob", F.round("prob", 6))


def event_shares(spark, sf_dir):
    """Event types of each user: node = user, token = type, prob = share."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("token")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "node").select("node", "token", (F.col("n") / F.col("total")).alias("prob"))


_SHARE_SQL = """
share AS (SELECT user_id AS node, event_type AS token, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS prob FROM events GROUP BY user_id, event_type)
"""


@query(
    "f10_softmax",
    f"""WITH {_SHARE_SQL}
SELECT node, token, round(exp(prob) / (sum(exp(prob)) OVER (PARTITION BY node) + 1000 - count(*) OVER (PARTITION BY node)), 9) AS prob FROM share""",
)
def f10_softmax(spark, sf_dir):
    return softmax(event_shares(spark, sf_dir), 1000).withColumn("prob", F.round("prob", 9))


@query(
    "f11_top_tokens",
    f"""WITH {_SHARE_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY prob DESC, token) - 1 AS INTEGER) AS rank FROM share)
SELECT node, token, round(prob, 6) AS prob, rank FROM r WHERE rank < 3""",
)
def f11_top_tokens(spark, sf_dir):
    return top_tokens(event_shares(spark, sf_dir), 3).withColumn("prob", F.round("prob", 6))


@query(
    "f11_sampled_tokens",
    f"""WITH {_SHARE_SQL},
k AS (SELECT *, ln((('0x' || substr(md5(concat_ws('|', '42', node, token)), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / prob AS k FROM share),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY k DESC, token) - 1 AS INTEGER) AS rank FROM k)
SELECT node, token, round(prob, 6) AS prob, rank FROM r WHERE rank < 3""",
)
def f11_sampled_tokens(spark, sf_dir):
    return top_tokens(event_shares(spark, sf_dir), 3, sampling=True, seed=42).withColumn("prob", F.round("prob", 6))


def _lexicon(dist):
    """Tokens of even length are nouns with an upper-case lemma, the others adjectives."""
    return dist.select("token").distinct().select(
        "token",
        F.when(F.length("token") % 2 == 0, "NOUN").otherwise("ADJ").alias("pos"),
        F.upper("token").alias("lemma"),
    )


@query(
    "f12_name_nodes",
    f"""WITH {_SHARE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY prob DESC, token) AS rank FROM share)
SELECT node, arg_min(upper(token), CASE WHEN length(token) % 2 = 0 THEN rank ELSE rank + 1000 END) AS name FROM r WHERE rank <= 2 GROUP BY node""",
)
def f12_name_nodes(spark, sf_dir):
    dist = event_shares(spark, sf_dir)
    return name_nodes(top_tokens(dist, 2), _lexicon(dist))


_NAMES_SQL = f"""{_CLOSURE_SQL}{_DIST_SQL},
leaf AS (SELECT child AS node FROM geo WHERE child NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL)),
above AS (SELECT u.* FROM up u JOIN leaf USING (node)),
n_leaves AS (SELECT ancestor, count(*) AS n FROM above GROUP BY ancestor),
rolled AS (SELECT a.ancestor AS node, d.token, round(sum(d.prob) / any_value(l.n), 9) AS prob
           FROM dist d JOIN above a USING (node) JOIN n_leaves l ON l.ancestor = a.ancestor GROUP BY a.ancestor, d.token),
best AS (SELECT node, arg_max(upper(token), prob) AS name FROM rolled GROUP BY node),
step AS (SELECT a.node, b.name, a.distance, row_number() OVER (PARTITION BY a.node, b.name ORDER BY a.distance DESC) AS nth
         FROM above a JOIN best b ON b.node = a.ancestor JOIN geo g ON g.child = a.ancestor WHERE a.distance > 0 AND g.parent IS NOT NULL)
"""


def _names(spark, sf_dir):
    """Names of the geography's nodes from their rolled-up order priorities."""
    edges = freeze(geography(spark, sf_dir), "edges")
    rolled = rollup_distribution(leaf_distribution(spark, sf_dir), edges).withColumn("prob", F.round("prob", 9))
    lexicon = rolled.select("token").distinct().select("token", F.lit("NOUN").alias("pos"), F.upper("token").alias("lemma"))
    names = name_nodes(top_tokens(rolled, 2), lexicon)
    return edges, path_names(edges, names)


@query(
    "f13_path_names",
    f"""{_NAMES_SQL}
SELECT l.node, coalesce((SELECT string_agg(name, ':' ORDER BY distance DESC) FROM step s WHERE s.node = l.node AND nth = 1), '') AS names FROM leaf l""",
)
def f13_path_names(spark, sf_dir):
    return _names(spark, sf_dir)[1].select("node", F.array_join("names", ":").alias("names"))


def attached(spark, sf_dir):
    """Corpus with predictions: each mention is typed by its lemma and, above it, its kind."""
    corpus = conversations(spark, sf_dir)
    mentions = conversation_mentions(spark, sf_dir)[1]
    named = mentions.select(
        "sent_id", "kind", "indices", F.array("lemma").alias("lemmas"), F.array("kind", "lemma").alias("names")
    )
    return attach_event_types(corpus, named)


_ATTACHED_SQL = f"""WITH {CORPUS_SQL},
p AS (SELECT sent_id, lemma || '|' || tok_idx || '|' || token || '|' || kind || ':' || lemma AS p, kind = 'nom' AS second, tok_idx FROM mention)
SELECT c.doc_id, c.sent_id, c.sentence, coalesce((SELECT string_agg(p, ' ' ORDER BY second, tok_idx) FROM p WHERE p.sent_id = c.sent_id), '') AS predictions FROM corpus c"""


def _flat(result):
    text = lambda p: F.concat_ws(
        "|", F.array_join(p["predicate_lemma"], ","), joined(p["predicate_index"], ","), p["predicate_text"], p["type_names"]
    )
    return result.select("doc_id", "sent_id", "sentence", F.array_join(F.transform("predictions", text), " ").alias("predictions"))


@query("f14_attach_event_types", _ATTACHED_SQL)
def f14_attach_event_types(spark, sf_dir):
    return _flat(attached(spark, sf_dir))


@query("a7_write_event_types", _ATTACHED_SQL)
def a7_write_event_types(spark, sf_dir):
    path = scratch_path(spark, "event-types")
    write_event_types(attached(spark, sf_dir), path)
    return _flat(read_event_types(spark, path))


@query(
    "f15_event_coverage",
    f"WITH {CORPUS_SQL} SELECT round(count(DISTINCT m.sent_id) / CAST(count(DISTINCT c.sent_id) AS DOUBLE), 6) AS coverage FROM corpus c LEFT JOIN mention m USING (sent_id)",
)
def f15_event_coverage(spark, sf_dir):
    return event_coverage(attached(spark, sf_dir)).select(F.round("coverage", 6).alias("coverage"))
