"""Schemas of the tables that cross operator boundaries (DDL strings)."""

CORPUS = "doc_id string, sent_id string, tokens array<string>, sentence string"

# One normalised shape for verb, nominal and preposition frames.
FRAME = (
    "struct<kind:string, text:string, indices:array<int>, predicate_index:array<int>, "
    "sense:string, description:string, tags:array<string>>"
)

FRAMES = f"sent_id string, words array<string>, frames array<{FRAME}>"

VERB_WIRE = (
    "sent_id string, words array<string>, verbs array<struct<verb:string, verb_index:int, "
    "predicate_index:array<int>, sense:string, description:string, tags:array<string>>>"
)
NOMINAL_WIRE = (
    "sent_id string, words array<string>, nominals array<struct<nominal:string, nominal_indices:array<int>, "
    "predicate_index:array<int>, sense:string, description:string, tags:array<string>>>"
)
PREPOSITION_WIRE = (
    "sent_id string, words array<string>, prepositions array<struct<preposition:string, "
    "predicate_index:array<int>, description:string, tags:array<string>>>"
)

SCORES_WIRE = "doc_id string, event_start_idx array<int>, pred array<double>, saliency array<int>"

EDGE = "child bigint, parent bigint, label int"

PREDICTION = "struct<predicate_lemma:array<string>, predicate_index:array<int>, predicate_text:string, type_names:string>"

MAVEN_WIRE = (
    "content array<struct<sentence:string>>, "
    "events array<struct<type:string, mention:array<struct<sent_id:int, trigger_word:string>>>>"
)
RAMS_WIRE = "doc_key string, sentences array<array<string>>, evt_triggers array<string>"
ACE_WIRE = "sentence string, event_mentions array<struct<event_type:string, trigger:struct<text:string>>>"

# Frame kinds in the order in which they win a shared token.
KINDS = ("verb", "nom", "prep")
