"""Sources and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgrove.functions.let import let, unpacked
from eventgrove.operators.corpus import corpus_from_table, tokens_only, union_instances, validate_corpus
from eventgrove.operators.mentions import annotate, mention_column
from eventgrove.operators.spans import split_compounds
from eventgrove.plans.scratch import scratch_path
from eventgrove.sources.annotated import (
    conll_instances,
    parse_preposition_lines,
    parse_span_lines,
    predicate_indicator,
    predicates_by_sentence,
    read_conll,
    read_conll_blocks,
    read_ontology_edges,
    read_prep_lines,
    read_span_lines,
)
from eventgrove.sources.corpus import read_corpus, read_event_dataset, read_frames
from eventgrove.sources.features import read_features, read_tree, stage, write_features, write_tree
from suite.base import CORPUS_SQL, FRAME_SQL, conversations, joined, query, table, texts
from suite.shapes import ace_shape, maven_shape, rams_shape
from suite.trees import GEO_SQL, geography


@query(
    "a1_corpus_from_table",
    f"WITH {CORPUS_SQL} SELECT doc_id, sent_id, sent_num, CAST(len(tokens) AS INTEGER) AS n_tokens,"
    " array_to_string(tokens, ' ') AS words, sentence FROM corpus",
)
def a1_corpus_from_table(spark, sf_dir):
    return conversations(spark, sf_dir).select(
        "doc_id", "sent_id", "sent_num", F.size("tokens").alias("n_tokens"), joined("tokens").alias("words"), "sentence"
    )


@query(
    "a1_read_corpus",
    f"WITH {CORPUS_SQL} SELECT doc_id, sent_id, sent_num, array_to_string(tokens, ' ') AS words FROM corpus",
)
def a1_read_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    conversations(spark, sf_dir).drop("sent_num").write.json(path)
    return read_corpus(spark, path).select("doc_id", "sent_id", "sent_num", joined("tokens").alias("words"))


@query(
    "a2_validate_corpus",
    """
WITH c AS (SELECT lang AS doc_id, lang || '-' || doc_id AS sent_id, doc_id AS sent_num FROM documents)
SELECT 'doc_id not numeric' AS "check", doc_id, sent_id FROM c WHERE NOT regexp_matches(doc_id, '^[0-9]+$')
UNION ALL
SELECT 'previous sentence missing', doc_id, sent_id FROM c
WHERE sent_num > (SELECT min(sent_num) FROM c d WHERE d.doc_id = c.doc_id)
  AND NOT EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.sent_num = c.sent_num - 1)
UNION ALL
SELECT 'sent_id repeated', min(doc_id), sent_id FROM c GROUP BY sent_id HAVING count(*) > 1
""",
)
def a2_validate_corpus(spark, sf_dir):
    # Languages as documents: not numeric, and with gaps in the sentence numbers.
    return validate_corpus(corpus_from_table(texts(spark, sf_dir, "documents"), "lang", "doc_id", "text"))


@query(
    "a2_validate_annotations",
    f"""WITH {CORPUS_SQL},
ann AS (SELECT sent_id, array_to_string(tokens, ' ') AS words FROM corpus WHERE sent_id IN (SELECT sent_id FROM mention WHERE kind = 'verb')),
low AS (SELECT sent_id, lower(words) AS words FROM ann)
SELECT 'sentence without annotation' AS "check", doc_id, sent_id FROM corpus WHERE sent_id NOT IN (SELECT sent_id FROM low)
UNION ALL
SELECT 'words differ from tokens', doc_id, c.sent_id FROM corpus c JOIN low USING (sent_id) WHERE array_to_string(c.tokens, ' ') <> low.words
""",
)
def a2_validate_annotations(spark, sf_dir):
    corpus = conversations(spark, sf_dir)
    # Annotations exist only where a verb does, and with lower-cased words.
    some = corpus.where(F.exists(mention_column(F.col("tokens")), lambda m: m["kind"] == "verb"))
    return validate_corpus(corpus, some.select("sent_id", F.transform("tokens", lambda t: F.lower(t)).alias("words")))


@query("a3_tokens_only", f"WITH {CORPUS_SQL} SELECT array_to_string(tokens, ' ') AS words FROM corpus")
def a3_tokens_only(spark, sf_dir):
    return tokens_only(conversations(spark, sf_dir)).select(joined("tokens").alias("words"))


@query(
    "a4_read_frames",
    f"""WITH {FRAME_SQL}
SELECT sent_id, kind, any_value(predicate) AS text, CAST("at" AS VARCHAR) AS indices, CASE kind WHEN 'verb' THEN '1.0' ELSE '1' END AS sense,
       string_agg(tag, ' ' ORDER BY tok_idx) AS tags
FROM tag GROUP BY "at", sent_id, kind""",
)
def a4_read_frames(spark, sf_dir):
    frames = annotate(conversations(spark, sf_dir))
    verbs, noms = scratch_path(spark, "verbs"), scratch_path(spark, "nominals")
    of_kind = lambda kind: F.filter("frames", lambda f: f["kind"] == kind)
    shared = lambda f: [f[n].alias(n) for n in ("predicate_index", "sense", "description", "tags")]
    frames.select(
        "sent_id",
        "words",
        F.transform(of_kind("verb"), lambda f: F.struct(f["text"].alias("verb"), F.get(f["indices"], F.lit(0)).alias("verb_index"), *shared(f))).alias("verbs"),
    ).write.json(verbs)
    frames.select(
        "sent_id",
        "words",
        F.transform(of_kind("nom"), lambda f: F.struct(f["text"].alias("nominal"), f["indices"].alias("nominal_indices"), *shared(f))).alias("nominals"),
    ).write.json(noms)
    both = read_frames(spark, verbs, "verb").unionByName(read_frames(spark, noms, "nom"))
    return both.select("sent_id", F.inline("frames")).select(
        "sent_id", "kind", "text", joined("indices").alias("indices"), "sense", joined("tags").alias("tags")
    )


@query(
    "a5_feature_lines",
    "SELECT vec_id AS id, label, CAST(d - 1 AS INTEGER) AS dim, round(CAST(embedding[d] AS DOUBLE), 6) AS value"
    " FROM (SELECT *, unnest(range(1, 65)) AS d FROM embeddings)",
)
def a5_feature_lines(spark, sf_dir):
    path = scratch_path(spark, "features")
    write_features(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features")), path)
    return read_features(spark, path).select("id", "label", F.posexplode("features").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query("a6_stage", "SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey")
def a6_stage(spark, sf_dir):
    path = scratch_path(spark, "stage")
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    stage(counts, path)
    # The finished stage is read back: the second frame would give other counts.
    return stage(counts.withColumn("customers", F.lit(0).cast("bigint")), path)


@query("a8_tree_file", f"WITH {GEO_SQL} SELECT child, parent, CAST(label AS INTEGER) AS label FROM geo")
def a8_tree_file(spark, sf_dir):
    path = scratch_path(spark, "tree")
    write_tree(geography(spark, sf_dir), path)
    return read_tree(spark, path)


def span_lines(spark, sf_dir):
    """``conv-N turn tokens ||| 01 rel ARG0 ARG1`` lines, one per rule mention."""
    rows = unpacked(conversations(spark, sf_dir), ["doc_id", "sent_num", "tokens"], mention_column(F.col("tokens")), "m")
    corpus = rows.select("doc_id", "sent_num", "tokens", F.size("tokens").alias("n"), "m.*")
    arg = lambda start, end, label: F.format_string(f"%d:%d-{label}", start, end)
    at = F.col("tok_idx")
    parts = F.array(
        arg(at, at, "rel"),
        F.when(at > 0, arg(at - 1, at - 1, "ARG0")),
        F.when(at + 1 < F.col("n"), arg(at + 1, F.least(at + 2, F.col("n") - 1), "ARG1")),
    )
    return corpus.select(
        F.concat_ws(" ", F.concat(F.lit("conv-"), "doc_id"), "sent_num", F.array_join("tokens", " "), F.lit("||| 01"), F.array_join(parts, " ")).alias("value")
    )


LINES_SQL = (
    CORPUS_SQL
    + r""",
line AS (SELECT 'conv-' || doc_id AS file, sent_num AS sentnum, sent_id, tok_idx, n_tokens FROM mention),
argument AS (
  SELECT file, sentnum, sent_id, tok_idx, unnest([
    {'label': 'rel', 'start': tok_idx, 'end': tok_idx},
    {'label': 'ARG0', 'start': tok_idx - 1, 'end': tok_idx - 1},
    {'label': 'ARG1', 'start': tok_idx + 1, 'end': least(tok_idx + 2, n_tokens - 1)}], recursive := true)
  FROM line),
arguments AS (SELECT * FROM argument WHERE "start" >= 0 AND "start" <= "end")
"""
)


@query(
    "a9_span_lines",
    f"""WITH {LINES_SQL}
SELECT a.file, a.sentnum, '01' AS sense, array_to_string(c.tokens, ' ') AS words, a.label, '' AS prefix, a."start", a."end"
FROM arguments a JOIN corpus c USING (sent_id)""",
)
def a9_span_lines(spark, sf_dir):
    path = scratch_path(spark, "span-lines")
    span_lines(spark, sf_dir).write.text(path)
    lines = read_span_lines(spark, path)
    rows = lines.select("file", "sentnum", "sense", joined("tokens").alias("words"), F.inline("arguments"))
    return rows.select("file", "sentnum", "sense", "words", "label", "prefix", F.inline("pieces")).select(
        "file", "sentnum", "sense", "words", "label", "prefix", "start", "end"
    )


@query(
    "a10_predicates_by_sentence",
    f"""WITH {LINES_SQL}
SELECT file, sentnum, string_agg(CAST(tok_idx AS VARCHAR), ' ' ORDER BY tok_idx) AS predicates,
       (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM mention m WHERE m.sent_id = t.sent_id AND m.tok_idx = t.tok_idx) THEN '1' ELSE '0' END, '' ORDER BY t.tok_idx)
        FROM tok t WHERE t.sent_id = line.sent_id) AS indicator
FROM line GROUP BY file, sentnum, sent_id""",
)
def a10_predicates_by_sentence(spark, sf_dir):
    grouped = predicate_indicator(
        split_compounds(predicates_by_sentence(parse_span_lines(span_lines(spark, sf_dir))), "attach")
    )
    return grouped.select(
        "file",
        "sentnum",
        joined(F.transform("predicates", lambda p: p["word"])).alias("predicates"),
        joined("indicator", "").alias("indicator"),
    )


def conll_blocks(spark, sf_dir):
    """CoNLL text of each conversation turn, one annotation column per rule mention."""

    def cell(i, at, n):
        return (
            F.when(i == at, "(V*)")
            .when(i == at - 1, "(ARG0*)")
            .when((i == at + 1) & (at + 2 < n), "(ARG1*")
            .when(i == at + 1, "(ARG1*)")
            .when(i == at + 2, "*)")
            .otherwise("*")
        )

    def lines(tokens, mentions, n):
        line = lambda t, i: F.concat_ws(
            " ",
            F.concat(F.lit("conv/"), "doc_id"),
            F.lit("0"),
            i.cast("string"),
            t,
            F.lit("X (TOP* - -"),
            F.array_join(F.transform(mentions, lambda m: cell(i, m["tok_idx"], n)), " "),
        )
        return F.array_join(F.transform(tokens, line), "\n")

    tokens = F.col("tokens")
    text = let(tokens, mention_column(tokens), F.size(tokens), body=lines)
    return conversations(spark, sf_dir).select(F.concat(text, F.lit("\n")).alias("value"))


_CONLL_SQL = f"""WITH {FRAME_SQL},
t AS (SELECT sent_id, frame, any_value(predicate) AS predicate, string_agg(tag, ' ' ORDER BY tok_idx) AS tags FROM tag GROUP BY sent_id, frame)
SELECT 'conv/' || c.doc_id AS doc_id, array_to_string(c.tokens, ' ') AS words, t.predicate, t.tags FROM corpus c LEFT JOIN t USING (sent_id)"""


def _conll_rows(sentences):
    return sentences.select("doc_id", joined("words").alias("words"), F.explode_outer("frames").alias("f")).select(
        "doc_id", "words", F.col("f.predicate").alias("predicate"), joined("f.tags").alias("tags")
    )


@query("a11_read_conll", _CONLL_SQL)
def a11_read_conll(spark, sf_dir):
    path = scratch_path(spark, "conll")
    conll_blocks(spark, sf_dir).write.text(path)
    return _conll_rows(read_conll(spark, path, suffix=".txt"))


@query("a11_conll_blocks", _CONLL_SQL)
def a11_conll_blocks(spark, sf_dir):
    # The same text with the other line ends, in splits far shorter than a file.
    path = scratch_path(spark, "conll-crlf")
    conll_blocks(spark, sf_dir).select(F.regexp_replace("value", "\n", "\r\n")).write.option("lineSep", "\r\n").text(path)
    return _conll_rows(read_conll_blocks(spark, path, suffix=".txt", split_bytes=100_000))


def preposition_lines(spark, sf_dir):
    rows = unpacked(annotate(conversations(spark, sf_dir)), ["sent_id", "words"], "frames", "frame", "f")
    renamed = F.transform(
        "f.tags",
        lambda t: F.when(t == "O", t).when(t == "B-V", "B-PREP").when(t == "B-ARG0", "B-GOV").otherwise(F.regexp_replace(t, "ARG1", "OBJ")),
    )
    return rows.select(
        F.concat_ws(" ", F.concat_ws("_", "sent_id", "frame"), F.array_join("words", " "), F.lit("||| p.Whole"), F.lit("p.Part"), F.array_join(renamed, " ")).alias("value")
    )


@query(
    "a12_preposition_lines",
    f"""WITH {FRAME_SQL}
SELECT sent_id || '_' || frame AS id, string_agg(token, ' ' ORDER BY tok_idx) AS words, 'p.Whole' AS supersense1, 'p.Part' AS supersense2,
       replace(replace(replace(string_agg(tag, ' ' ORDER BY tok_idx), 'B-V', 'B-PREP'), 'ARG0', 'GOV'), 'ARG1', 'OBJ') AS tags, true AS valid
FROM tag GROUP BY sent_id, frame""",
)
def a12_preposition_lines(spark, sf_dir):
    path = scratch_path(spark, "preposition-lines")
    preposition_lines(spark, sf_dir).write.text(path)
    return read_prep_lines(spark, path).select(
        "id", joined("tokens").alias("words"), "supersense1", "supersense2", joined("tags").alias("tags"), "valid"
    )


@query(
    "a13_event_datasets",
    f"""WITH {CORPUS_SQL}
SELECT 'ace2005' AS dataset, sentence, 'Event:' || kind AS event_type, token AS trigger FROM mention JOIN corpus USING (sent_id)
UNION ALL
SELECT DISTINCT 'maven', sentence, kind, token FROM mention JOIN corpus USING (sent_id)
UNION ALL
SELECT 'rams', array_to_string(tokens, ' '), 'event.' || kind || '.n/a', token FROM mention JOIN corpus USING (sent_id)""",
)
def a13_event_datasets(spark, sf_dir):
    corpus = conversations(spark, sf_dir)
    read = []
    for name, shape in (("ace2005", ace_shape), ("maven", maven_shape), ("rams", rams_shape)):
        path = scratch_path(spark, name)
        shape(corpus).write.json(path)
        read.append(read_event_dataset(spark, path, name).withColumn("dataset", F.lit(name)))
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(
    "a14_ontology_text",
    """
WITH t AS (SELECT DISTINCT 'Item' AS a, replace(p_brand, '#', '') AS b, p_type AS c, p_size > 25 AS known FROM part)
SELECT a AS parent, b AS child FROM t UNION SELECT b, c FROM t WHERE known""",
)
def a14_ontology_text(spark, sf_dir):
    path = scratch_path(spark, "ontology")
    kinds = table(spark, sf_dir, "part").select(
        F.concat(
            F.lit("ldcOnt:Item."), F.regexp_replace("p_brand", "#", ""), F.lit("."), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("n/a"), F.lit(" text")
        ).alias("line")
    ).distinct()
    # One line per distinct type; an ontology is a small text file.
    body = F.array_join(F.sort_array(F.collect_set("line")), "\n")
    kinds.agg(F.concat(F.lit("ldcOnt:No.Type\n# Event types\n"), body, F.lit("\n# Event argument types\nldcOnt:Not.Read x")).alias("value")).write.text(path)
    return read_ontology_edges(spark, path)


@query(
    "a15_union_instances",
    f"""WITH {FRAME_SQL},
i AS (SELECT sent_id, frame, string_agg(token, ' ' ORDER BY tok_idx) AS words, string_agg(CASE WHEN tag = 'B-V' THEN '1' ELSE '0' END, '' ORDER BY tok_idx) AS indicator,
             string_agg(tag, ' ' ORDER BY tok_idx) AS tags FROM tag GROUP BY sent_id, frame)
SELECT 'columns' AS source, words, indicator, tags FROM i
UNION ALL
SELECT 'columns', array_to_string(tokens, ' '), repeat('0', len(tokens)), trim(repeat('O ', len(tokens))) FROM corpus WHERE sent_id NOT IN (SELECT sent_id FROM i)
UNION ALL
SELECT 'prepositions', words, indicator, replace(replace(replace(tags, 'B-V', 'B-PREP'), 'ARG0', 'GOV'), 'ARG1', 'OBJ') FROM i""",
)
def a15_union_instances(spark, sf_dir):
    path = scratch_path(spark, "conll")
    conll_blocks(spark, sf_dir).write.text(path)
    columns = conll_instances(read_conll(spark, path, suffix=".txt"))
    prepositions = parse_preposition_lines(preposition_lines(spark, sf_dir)).where("valid")
    rows = union_instances(columns=columns, prepositions=prepositions)
    return rows.select(
        "source", joined("tokens").alias("words"), joined("indicator", "").alias("indicator"), joined("tags").alias("tags")
    )
