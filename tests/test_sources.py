from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventgrove.operators.corpus import validate_corpus
from eventgrove.operators.hierarchies import hierarchy_edges, hierarchy_paths, label_parts, parents_of
from eventgrove.operators.mentions import annotate, annotate_sentences
from eventgrove.operators.spans import split_compounds
from eventgrove.sources.annotated import (
    conll_instances,
    parse_preposition_lines,
    parse_span_lines,
    predicate_indicator,
    predicates_by_sentence,
    read_conll,
    read_ontology_edges,
)
from eventgrove.sources.corpus import read_corpus, read_event_dataset, read_frames, write_event_types
from eventgrove.sources.features import read_features, read_tree, stage, write_features, write_tree


def lines_file(path, records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_corpus_and_contract(spark, tmp_path):
    path = lines_file(
        tmp_path / "c.jsonl",
        [
            {"doc_id": "276", "sent_id": "276-0", "tokens": ["NEW", "You"], "sentence": "NEW You"},
            {"doc_id": "276", "sent_id": "276-2", "tokens": ["can"], "sentence": "can"},
            {"doc_id": "x", "sent_id": "x-0", "tokens": ["a"], "sentence": "a"},
        ],
    )
    corpus = read_corpus(spark, path)
    found = {(r["check"], r["sent_id"]) for r in validate_corpus(corpus).collect()}
    assert found == {("previous sentence missing", "276-2"), ("doc_id not numeric", "x-0")}
    words = corpus.where("doc_id = '276'").select("sent_id", F.upper(F.concat_ws(" ", "tokens")).alias("w"))
    checked = validate_corpus(corpus, words.select("sent_id", F.split("w", " ").alias("words")))
    assert {r["sent_id"] for r in checked.where("check = 'words differ from tokens'").collect()} == {"276-0", "276-2"}
    assert [r["sent_id"] for r in checked.where("check = 'sentence without annotation'").collect()] == ["x-0"]


def test_frames_of_every_kind(spark, tmp_path):
    verb = lines_file(
        tmp_path / "v.jsonl",
        [{"sent_id": "1-0", "words": ["He", "ran", "home"], "verbs": [{"verb": "ran", "verb_index": 1, "predicate_index": [1], "sense": "1.0", "description": "", "tags": ["B-ARG0", "B-V", "B-ARG1"]}]}],
    )
    nominal = lines_file(
        tmp_path / "n.jsonl",
        [{"sent_id": "1-0", "words": ["a", "b"], "nominals": [{"nominal": "a b", "nominal_indices": [0, 1], "predicate_index": [0, 1], "sense": "01", "description": "", "tags": ["B-V", "I-V"]}]}],
    )
    prep = lines_file(tmp_path / "p.jsonl", [{"sent_id": "1-0", "words": ["of"], "prepositions": [{"preposition": "of", "predicate_index": [0], "description": "", "tags": ["B-PREP"]}]}])
    rows = read_frames(spark, verb, "verb").union(read_frames(spark, nominal, "nom")).union(read_frames(spark, prep, "prep"))
    got = [(f["kind"], f["indices"], f["sense"]) for r in rows.collect() for f in r["frames"]]
    assert sorted(got) == [("nom", [0, 1], "01"), ("prep", [0], None), ("verb", [1], "1.0")]


def test_custom_annotator_runs_on_batches(spark):
    corpus = spark.createDataFrame([("d-0", ["a", "b"])], "sent_id string, tokens array<string>")

    def annotator(batches):
        for batch in batches:
            yield batch.rename(columns={"tokens": "words"}).assign(frames=[[] for _ in range(len(batch))])

    assert annotate(corpus, annotator).first()["frames"] == []


def test_span_lines_and_grouping(spark):
    text = [
        "wsj/05/wsj_0544.mrg 0 Air & Water asbestos-abatement concern . ||| 01 3_1:3_1-rel 3_0:3_0-ARG1",
        "wsj/05/wsj_0544.mrg 0 Air & Water asbestos-abatement concern . ||| 01 4:4-rel 0:0*2:2-ARG0 3:3-Support",
    ]
    lines = parse_span_lines(spark.createDataFrame([(t,) for t in text], "value string"))
    first = lines.where("args[0] like '3_1%'").first()
    assert first["sense"] == "01" and first["tokens"][3] == "asbestos-abatement"
    assert [(a["label"], a["pieces"][0]["start"], a["pieces"][0]["start_part"]) for a in first["arguments"]] == [("rel", 3, 1), ("ARG1", 3, 0)]
    grouped = predicate_indicator(split_compounds(predicates_by_sentence(lines), "attach")).first()
    assert [(p["word"], p["part"]) for p in grouped["predicates"]] == [(3, 1), (4, None)]
    assert grouped["new_tokens"] == ["Air", "&", "Water", "asbestos-", "abatement", "concern", "."]
    assert grouped["indicator"] == [0, 0, 0, 0, 1, 1, 0]


def test_preposition_lines(spark):
    rows = spark.createDataFrame([("r_0 One of us ||| p.Q p.W B-GOV B-PREP B-OBJ",), ("r_1 a b ||| p.Q p.W O",)], "value string")
    got = {r["id"]: r for r in parse_preposition_lines(rows).collect()}
    assert got["r_0"]["valid"] and got["r_0"]["indicator"] == [0, 1, 0] and got["r_0"]["supersense2"] == "p.W"
    assert not got["r_1"]["valid"]


def test_conll(spark, tmp_path):
    folder = tmp_path / "x" / "bolt" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.gold_conll").write_text(
        "#begin document (bolt/a); part 000\n"
        "bolt/a 0 0 He PRP (TOP(S(NP*) - - (ARG0*)\n"
        "bolt/a 0 1 ran VBD (VP*)) run 01 (V*)\n"
        "\n"
        "bolt/a 0 0 No UH (TOP*) - -\n"
        "#end document\n"
    )
    (folder / "a.gold_skel").write_text("bolt/a 0 0 skip X * - -\n")
    got = {tuple(r["words"]): r for r in read_conll(spark, str(tmp_path), domain="bolt").collect()}
    assert set(got) == {("He", "ran"), ("No",)}
    row = got[("He", "ran")]
    assert (row["lemmas"], row["framesets"], row["pos"]) == ([None, "run"], [None, "01"], ["PRP", "VBD"])
    assert [(f["predicate"], f["tags"]) for f in row["frames"]] == [("ran", ["B-ARG0", "B-V"])]
    assert read_conll(spark, str(tmp_path), domain="wsj").count() == 0
    instances = {tuple(r["tags"]): r["indicator"] for r in conll_instances(read_conll(spark, str(tmp_path))).collect()}
    assert instances == {("B-ARG0", "B-V"): [0, 1], ("O",): [0]}


def test_ontology_text(spark, tmp_path):
    path = lines_file(
        tmp_path / "o.txt",
        ["ldcOnt:Before.It a", "# Event types", "ldcOnt:A.B.n/a x", "ldcOnt:A.C.D y", "ldcOnt:A.C.D z", "# Event argument types", "ldcOnt:After.It b"],
    )
    assert sorted(map(tuple, read_ontology_edges(spark, path).collect())) == [("A", "B"), ("A", "C"), ("C", "D")]


def test_event_sets(spark, tmp_path):
    ace = lines_file(tmp_path / "ace", [{"sentence": "He died", "event_mentions": [{"event_type": "Life:Die", "trigger": {"text": "died"}}]}])
    assert list(map(tuple, read_event_dataset(spark, ace, "ace2005").collect())) == [("He died", "Life:Die", "died")]
    twice = {"sent_id": 1, "trigger_word": "b"}
    maven = lines_file(tmp_path / "maven", [{"content": [{"sentence": "a"}, {"sentence": "b c"}], "events": [{"type": "T", "mention": [twice, twice, {"sent_id": 0, "trigger_word": "a"}]}]}])
    assert sorted(map(tuple, read_event_dataset(spark, maven, "maven").collect())) == [("a", "T", "a"), ("b c", "T", "b")]
    rams = lines_file(
        tmp_path / "rams",
        [{"doc_key": "k", "sentences": [["a", "b"], ["c"], ["d", "e"]], "evt_triggers": [[1, 1, [["x.y.n/a", 1.0]]], [4, 4, [["p.q.r", 1.0], ["s.t.u", 0.5]]]]}],
    )
    assert sorted(map(tuple, read_event_dataset(spark, rams, "rams").collect())) == [
        ("a b", "x.y.n/a", "b"), ("d e", "p.q.r", "e"), ("d e", "s.t.u", "e")
    ]


def test_feature_and_tree_files(spark, tmp_path):
    features = spark.createDataFrame([(0, 0, [0.1, -0.2]), (1, 0, [1e-9, 3.0])], "id bigint, label int, features array<float>")
    write_features(features, str(tmp_path / "f"))
    assert sorted(read_features(spark, str(tmp_path / "f")).collect()) == sorted(features.collect())
    edges = spark.createDataFrame([(0, 4, 0), (4, 6, None), (6, None, None)], "child bigint, parent bigint, label int")
    write_tree(edges, str(tmp_path / "t"))
    assert "6\tNone\tNone" in "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert sorted(read_tree(spark, str(tmp_path / "t")).collect(), key=lambda r: r["child"]) == edges.collect()


def test_stage_redoes_unfinished_writes(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stage(spark.range(3), path).count() == 3
    assert stage(spark.range(5), path).count() == 3
    assert stage(spark.range(5), path, overwrite=True).count() == 5
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert stage(spark.range(7), path).count() == 7


def test_result_file_keeps_empty_sentences(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "1-0", 0, ["a"], "a", [])],
        "doc_id string, sent_id string, sent_num int, tokens array<string>, sentence string, predictions array<struct<type_names:string>>",
    )
    write_event_types(rows, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert json.loads(text) == {"doc_id": "1", "sent_id": "1-0", "tokens": ["a"], "sentence": "a", "predictions": []}


def test_hierarchies(spark, one):
    edges = hierarchy_edges(spark).cache()
    counts = {r["dataset"]: r["n"] for r in edges.groupBy("dataset").agg(F.count_distinct("child").alias("n")).collect()}
    assert counts["ace2005"] == 33 and counts["maven"] > 168
    paths = {r["label"]: r["path"] for r in hierarchy_paths(edges.where("dataset = 'maven'")).collect()}
    assert paths["Cure"] == ["Change", "Cause_change_of_strength", "Recovering", "Cure"] and paths["Action"] == ["Action"]
    assert parents_of(edges).where("child = 'die'").first()["parents"] == ["life"]
    assert one("l string", ["a.n/a.b.n/a.n/a"], label_parts(F.col("l"), "rams")) == ["a", "n/a", "b"]
    assert one("l string", ["Life:Die"], label_parts(F.col("l"), "ace2005")) == ["Life", "Die"]


def test_annotation_of_a_stream(spark, tmp_path):
    """Row-local operators take a streaming frame as it is."""
    schema = "doc_id string, sent_id string, tokens array<string>, sentence string"
    (tmp_path / "in").mkdir()
    lines_file(tmp_path / "in" / "a.json", [{"doc_id": "1", "sent_id": "1-0", "tokens": ["we", "walked"], "sentence": "we walked"}])
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("sent_num", F.lit(0))
    run = (
        annotate_sentences(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    run.awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert [(m["kind"], m["tok_idx"], m["lemma"]) for m in row["mentions"]] == [("verb", 1, "walk")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_split_anywhere(end):
    import io

    from eventgrove.sources.blocks import blocks_of

    text = end.join(["a 1", "a 2", "", "b", " \t", "", "# note", "c", "", "", "d" * 50, "e", ""]) + "last"
    want = [b"a 1\na 2", b"b", b"# note\nc", b"d" * 50 + b"\ne", b"last"]
    want = [b"a 1\na 2", b"b", b"# note\nc", b"d" * 50 + b"\ne\nlast"] if "e" + end + "last" in text else want
    for size in range(1, 40):
        got = [b for start in range(0, len(text), size) for b in blocks_of(io.BytesIO(text.encode()), start, start + size)]
        assert got == want


def test_block_source(spark, tmp_path):
    from eventgrove.sources.blocks import register

    (tmp_path / "bc" / "x").mkdir(parents=True)
    (tmp_path / "nw").mkdir()
    (tmp_path / "bc" / "x" / "one.gold_conll").write_bytes(b"\r\n\r\n".join(b"w %d\r\nv" % i for i in range(500)) + b"\r\n")
    (tmp_path / "nw" / "two.gold_conll").write_bytes(b"other\n")
    (tmp_path / "bc" / "_skip.gold_conll").write_bytes(b"no\n")
    (tmp_path / "bc" / "three.txt").write_bytes(b"no\n")
    register(spark)
    read = spark.read.format("text_blocks").option("suffix", "gold_conll").option("splitBytes", 300)
    rows = read.option("domain", "bc").load(str(tmp_path)).collect()
    assert sorted(r["value"] for r in rows) == sorted(f"w {i}\nv" for i in range(500))
    assert {r["file"] for r in rows} == {str(tmp_path / "bc" / "x" / "one.gold_conll")}
    assert spark.read.format("text_blocks").option("suffix", ".none").load(str(tmp_path)).count() == 0
