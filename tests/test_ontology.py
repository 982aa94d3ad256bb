from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventgrove.functions import vectors as vec
from eventgrove.operators.embeddings import Layer, combine_vectors, feature_table, lookup_sense, predicate_vectors, project_vectors
from eventgrove.operators.evaluate import combined_score, decode_bio, span_prf, train_validation_split
from eventgrove.operators.naming import attach_event_types, name_nodes, path_names, softmax, top_tokens
from eventgrove.operators.prompts import Limits, build_prompts, sample_demonstrations
from eventgrove.operators.tree import renumber_tree, rollup_distribution, rollup_son, tree_check, tree_closure

EDGES = [(0, 4, 0), (1, 4, 0), (2, 5, 0), (4, 5, None), (3, 6, 0), (5, 6, None), (6, None, None)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "child bigint, parent bigint, label int")


def dist_rows(spark):
    return spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0), (2, "a", 0.5), (2, "c", 0.5), (3, "b", 1.0)], "node bigint, token string, prob double")


def test_closure_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(40)] + [(40, None, None)], "child bigint, parent bigint, label int")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in tree_closure(chain).collect()}
    assert got == {(i, j): j - i for i in range(41) for j in range(i, 41)}


def test_rollup_is_the_mean_over_leaves(spark, edges):
    got = {(r["node"], r["token"]): r["prob"] for r in rollup_distribution(dist_rows(spark), edges).collect()}
    assert got[(6, "a")] == pytest.approx(1.5 / 4) and got[(6, "b")] == pytest.approx(0.5) and got[(5, "c")] == pytest.approx(0.5 / 3)
    assert sum(p for (n, _), p in got.items() if n == 6) == pytest.approx(1)


def test_rollup_son_equals_dense_softmax(spark, edges):
    vocabulary = ["a", "b", "c", "d", "e"]
    dense = {n: np.zeros(5) for n in range(4)}
    for row in dist_rows(spark).collect():
        dense[row["node"]][vocabulary.index(row["token"])] = row["prob"]
    for node, children in ((4, (0, 1)), (5, (2, 4)), (6, (3, 5))):
        e = np.exp(np.mean([dense[c] for c in children], axis=0))
        dense[node] = e / e.sum()
    values, absent = rollup_son(dist_rows(spark), edges, 5)
    explicit = {(r["node"], r["token"]): r["prob"] for r in values.collect()}
    rest = {r["node"]: r["absent"] for r in absent.collect()}
    for node in (4, 5, 6):
        got = [explicit.get((node, token), rest[node]) for token in vocabulary]
        assert np.allclose(got, dense[node])


def test_renumber_puts_the_root_last(spark):
    rows = [(0, 90, 0), (1, 90, 0), (90, 50, None), (2, 50, 0), (50, None, None)]
    tree = spark.createDataFrame(rows, "child bigint, parent bigint, label int")
    got = {r["child"]: r["parent"] for r in renumber_tree(tree).collect()}
    assert got == {0: 3, 1: 3, 3: 4, 2: 4, 4: None}
    assert tree_check(renumber_tree(tree), 3).count() == 0


def test_names_between_root_and_leaf(spark, edges):
    names = spark.createDataFrame([(4, "x"), (5, "x"), (6, "root")], "node bigint, name string")
    got = {r["node"]: r["names"] for r in path_names(edges, names).collect()}
    # repeats keep the first; a leaf right below the root has no name
    assert got == {0: ["x"], 1: ["x"], 2: ["x"], 3: []}


def test_node_names_prefer_nouns_and_verbs(spark):
    top = spark.createDataFrame([(1, "the", 0), (1, "ran", 1), (1, "dog", 2), (2, "of", 0), (2, "to", 1)], "node bigint, token string, rank int")
    lexicon = spark.createDataFrame([("the", "DET", "the"), ("ran", "VERB", "run"), ("dog", "NOUN", "dog"), ("of", "ADP", "of")], "token string, pos string, lemma string")
    assert {r["node"]: r["name"] for r in name_nodes(top, lexicon).collect()} == {1: "run", 2: "of"}


def test_softmax_sums_to_one(spark):
    dist = dist_rows(spark)
    got = softmax(dist, 10)
    sums = {r["node"]: (r["s"], r["n"]) for r in got.groupBy("node").agg(F.sum("prob").alias("s"), F.count("*").alias("n")).collect()}
    for node, (explicit, n) in sums.items():
        whole = sum(math.exp(r["prob"]) for r in dist.where(F.col("node") == node).collect()) + 10 - n
        assert explicit + (10 - n) / whole == pytest.approx(1)


def test_weighted_sample_follows_the_weights(spark):
    rows = spark.range(3000).select(F.col("id").alias("node"), F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).alias("prob")) for t, p in (("a", 0.7), ("b", 0.2), ("c", 0.1))])).alias("r")).select("node", "r.*")
    first = top_tokens(rows, 1, sampling=True, seed=7).groupBy("token").count().collect()
    share = {r["token"]: r["count"] / 3000 for r in first}
    assert abs(share["a"] - 0.7) < 0.05 and abs(share["c"] - 0.1) < 0.03
    assert top_tokens(rows, 2, sampling=True, seed=7).groupBy("node").agg(F.count_distinct("token").alias("n")).where("n != 2").count() == 0


def test_demonstration_draws_ignore_partitions(spark):
    targets = spark.createDataFrame([(f"t{i}",) for i in range(20)], "target_id string")
    demos = spark.createDataFrame([(f"in{i}", f"o{i}", "p") for i in range(7)], "input string, output string, predicate string")
    pick = lambda n: sorted(map(tuple, sample_demonstrations(targets.repartition(n), demos.repartition(n), 5, 3).select("target_id", "draw", "input").collect()))
    assert pick(1) == pick(6) and len(pick(1)) == 100 and len({p[2] for p in pick(1)}) == 7


def test_prompts(spark):
    targets = spark.createDataFrame([("t", "x y z", "run"), ("u", "q", "go")], "target_id string, input string, predicate string")
    sampled = spark.createDataFrame(
        [("t", 1, "c d", "type2", "p2"), ("t", 0, "a b", "type1", "p1")], "target_id string, draw int, input string, output string, predicate string"
    )
    got = {r["target_id"]: r for r in build_prompts(targets, sampled).collect()}
    assert got["t"]["prompt"] == (
        "a b predicate: p1 event type: type1 sentence: c d predicate: p2 event type: type2 sentence: x y z predicate: run event type:"
    )
    assert got["u"]["prompt"] == "sentence: q predicate: go event type:" and not got["u"]["truncated"]
    null = {r["target_id"]: r["prompt"] for r in build_prompts(targets, sampled, null_input=True).collect()}
    assert null["u"] == "sentence: N/A predicate: N/A event type:"
    short = {r["target_id"]: r for r in build_prompts(targets, sampled, limits=Limits(per_example=8, whole=9)).collect()}
    # examples keep their output, the whole keeps its end
    assert short["t"]["prompt"] == "event type: type2 sentence: x y z event type:"[len("event type: "):] or short["t"]["truncated"]
    assert len(short["t"]["prompt"].split()) == 9 and short["t"]["truncated"]


def test_predictions_are_ordered_and_never_missing(spark):
    corpus = spark.createDataFrame([("1", "1-0", ["a", "b", "c"]), ("1", "1-1", ["d"])], "doc_id string, sent_id string, tokens array<string>")
    named = spark.createDataFrame(
        [("1-0", "nom", [0, 2], ["a"], ["x", "y"]), ("1-0", "verb", [1], ["b"], [])],
        "sent_id string, kind string, indices array<int>, lemmas array<string>, names array<string>",
    )
    got = {r["sent_id"]: r["predictions"] for r in attach_event_types(corpus, named).collect()}
    assert [(p["predicate_text"], p["type_names"]) for p in got["1-0"]] == [("b", ""), ("a c", "x:y")] and got["1-1"] == []


def test_sense_key_is_chosen_before_the_sense(spark):
    senses = spark.createDataFrame([("run_v", "1", "v1"), ("run_n", "2", "n2"), ("go", "1", "g1")], "lemma_key string, sense_id string, value string")
    mentions = spark.createDataFrame(
        [("a", "verb", "1.0", ["run"]), ("b", "verb", "2.0", ["run"]), ("c", "nom", "1", ["zz", "go"]), ("d", "verb", "1.5", ["go"]), ("e", "verb", None, ["go"])],
        "mention_id string, kind string, sense string, lemmas array<string>",
    )
    got = {r["mention_id"]: r["value"] for r in lookup_sense(mentions, senses).collect()}
    # run_v exists, so sense 2 of run_n is out of reach
    assert got == {"a": "v1", "b": None, "c": "g1", "d": None, "e": None}


def test_piece_means(spark):
    frames = spark.createDataFrame(
        [("s", ["x", "yy"], [("verb", "x", [0], [0], "1", "", ["B-V", "B-R-ARG1"])])],
        "sent_id string, words array<string>, frames array<struct<kind:string,text:string,indices:array<int>,predicate_index:array<int>,sense:string,description:string,tags:array<string>>>",
    )
    hidden = spark.createDataFrame([("s", [None, 0, 1, 1, None], [[9.0], [1.0], [2.0], [4.0], [9.0]])], "sent_id string, word_ids array<int>, hidden array<array<float>>")
    row = predicate_vectors(frames, hidden).first()
    assert (row["predicate_emb"], row["arg1_emb"], row["arg2_emb"]) == ([1.0], [3.0], None)


def test_combined_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [7.0]), (None, [3.0, 4.0], [7.0]), (None, None, [7.0])], "b array<float>, a array<float>, f array<float>")
    mean = [r["features"] for r in combine_vectors(rows, ["b", "a"], fallback="f").collect()]
    assert mean == [[2.0, 3.0], [3.0, 4.0], [7.0]]
    joined = [r["features"] for r in combine_vectors(rows, ["b", "a"], "concat").collect()]
    assert joined == [[3.0, 4.0, 1.0, 2.0], [3.0, 4.0], None]
    with pytest.raises(Exception, match="NaN"):
        combine_vectors(spark.createDataFrame([([float("nan")],)], "b array<float>"), ["b"]).collect()


def test_vector_expressions(one):
    assert one("v array<float>", [[0.0, 0.0]], vec.l2_normalize(F.col("v"))) == [0.0, 0.0]
    assert one("v array<float>", [[3.0, 4.0]], vec.l2_normalize(F.col("v"))) == pytest.approx([0.6, 0.8])
    schema = "v array<array<float>>, m array<int>"
    assert one(schema, [[[1.0], [5.0], [9.0]], [1, 1, 0]], vec.masked_mean(F.col("v"), F.col("m"))) == [3.0]
    assert one(schema, [[[1.0]], [0]], vec.masked_mean(F.col("v"), F.col("m"))) == [0.0]
    assert one("w array<int>", [[None, 0, 0, 1, None]], vec.pieces_by_word(F.col("w"))) == [[1, 2], [3]]


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(1)
    layers = [Layer(rng.normal(size=(3, 4)), rng.normal(size=3), rng.normal(size=3), rng.random(3) + 0.5, rng.normal(size=3), rng.normal(size=3)),
              Layer(rng.normal(size=(2, 3)), rng.normal(size=2), np.zeros(2), np.ones(2), np.ones(2), np.zeros(2), activate=False)]
    x = rng.normal(size=(5, 4))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id bigint, features array<double>")
    got = np.array([r["features"] for r in project_vectors(rows, layers).sort("id").collect()])
    h = x @ layers[0].weight.T + layers[0].bias
    h = np.where(h > 0, h, 0.01 * h)
    h = (h - layers[0].mean) / np.sqrt(layers[0].variance + 1e-5) * layers[0].scale + layers[0].shift
    assert np.allclose(got, h @ layers[1].weight.T + layers[1].bias)


def test_feature_ids(spark):
    rows = lambda keys: spark.createDataFrame([(k, [float(k)]) for k in keys], "source_idx bigint, features array<double>")
    got = feature_table(rows([0, 1]), rows([0, 1, 2])).sort("id").collect()
    assert [(r["id"], r["kind"], r["source_idx"]) for r in got] == [(0, "verb", 0), (1, "verb", 1), (2, "nom", 0), (3, "nom", 1), (4, "nom", 2)]


def brute_decode(probs, labels):
    """Best valid sequence by trying all of them."""
    import itertools

    best = None
    for path in itertools.product(range(len(labels)), repeat=len(probs)):
        tags = [labels[i] for i in path]
        ok = all(not t.startswith("I-") or (i > 0 and tags[i - 1][1:] == t[1:] and tags[i - 1] != "O") for i, t in enumerate(tags))
        score = sum(p[i] for p, i in zip(probs, path))
        if ok and (best is None or score > best[1]):
            best = (tags, score)
    return best


def test_decoding_equals_brute_force(spark):
    labels = ["O", "B-A", "I-A", "B-B", "I-B"]
    rng = np.random.default_rng(2)
    data = {i: rng.dirichlet(np.ones(5) * 0.4, size=5) for i in range(6)}
    data[6] = np.array([[0.1, 0.1, 0.8, 0, 0], [0.2, 0, 0.8, 0, 0]])  # the unconstrained best starts inside
    rows = [(i, pos, [float(x) for x in p]) for i, seq in data.items() for pos, p in enumerate(seq)]
    got = {r["seq_id"]: r for r in decode_bio(spark.createDataFrame(rows, "seq_id int, pos int, probs array<double>"), labels).collect()}
    for i, probs in data.items():
        tags, score = brute_decode(probs, labels)
        assert got[i]["score"] == pytest.approx(score) and got[i]["tags"] == tags


def test_published_combined_scores(one):
    # F1 times accuracy, in percent: two rows of the published results.
    for f1, accuracy, expected in ((82.149, 0.97900, 80.424), (84.146, 0.88142, 74.168)):
        assert one("f double, a double", [f1, accuracy], combined_score(F.col("f"), F.col("a"))) == pytest.approx(expected, abs=1e-3)


def test_span_scores(spark):
    rows = lambda data: spark.createDataFrame(data, "s string, label string, start int, end int")
    got = {r["label"]: r for r in span_prf(rows([("a", "X", 0, 1), ("a", "Y", 2, 3), ("a", "V", 1, 2)]), rows([("a", "X", 0, 1), ("a", "Y", 2, 4)]), ["s"]).collect()}
    assert (got[None]["correct"], got[None]["predicted"], got[None]["gold"], got[None]["f1"]) == (1, 2, 2, 0.5)
    assert got["X"]["f1"] == 1.0 and got["Y"]["f1"] == 0.0


def test_hash_split_is_stable_and_whole(spark):
    df = spark.range(5000)
    train, validation = train_validation_split(df, "id", 0.1, seed=1)
    assert train.count() + validation.count() == 5000 and 400 < validation.count() < 600
    again = train_validation_split(df.repartition(9), "id", 0.1, seed=1)[1]
    assert sorted(r["id"] for r in validation.collect()) == sorted(r["id"] for r in again.collect())
    assert train_validation_split(df, "id", 0.1, max_train=7)[0].count() == 7
