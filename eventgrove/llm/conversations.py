"""Repair of conversations whose turns are blank, repeated, cut off or out of order of roles.

Rows are placed in one range sort, so a long conversation lies in many tasks. It is cut into pieces of
``PIECE_ROWS``; each piece is parsed for every stack top that it may start from (``role_parser``), the
tables of neighbouring pieces are combined in rounds of ``FAN_IN``, and the cheapest way is then followed
back from the whole conversation to its pieces, which gives every row its edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgrove.llm.role_parser import CUT, DOOMED, SOUND, flat, illegal_pairs, nested, solved, stacks
from eventgrove.plans.ordering import dense_index
from eventgrove.plans.scratch import freeze

PIECE_BITS = 9
FAN_BITS = 4
WHITE = " \t\n\x0b\f\r"
NONE = " "  # what a null role or text is read as
TABLE = "array<struct<start:int, end:int, cost:bigint, audit:string>>"
CHOICES = "array<struct<idx:bigint, start:int, end:int>>"
LEFT = "array<struct<seq:int, at:bigint, role:string>>"


@dataclass(frozen=True)
class Repair:
    """``report``: one row per conversation. ``rows``: conv_id, key, place (ascending in a conversation), role, text."""

    report: DataFrame
    rows: DataFrame


def last_visible(text: Column) -> Column:
    """Last character that is no white space, empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)


def row_code(role: Column, last: Column, repeated: Column) -> Column:
    """The parser's code of a row, by its first fault and its role's initial; ``last`` is its last visible character."""
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    pick = lambda codes: F.element_at(F.array(*(F.lit(c) for c in codes)), place)
    return F.when((last == "") | repeated, pick(DOOMED)).when(~last.isin(".", "!", "?"), pick(CUT)).otherwise(pick(SOUND))


def _mapped(df: DataFrame, made: dict[str, str], drop: tuple[str, ...], compute) -> DataFrame:
    """``df`` without ``drop``, with columns that ``compute(row)`` gives for each row, batch by batch."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # long pieces: few at once
                part = batch.slice(at, 512)
                results = [compute(row) for row in part.to_pylist()]
                columns = {f.name: part.column(f.name) for f in kept}
                for i, name in enumerate(made):
                    columns[name] = pa.array([r[i] for r in results], type=types[name])
                yield pa.RecordBatch.from_pydict(columns)

    table = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    choice = pa.list_(pa.struct([("idx", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    left = pa.list_(pa.struct([("seq", pa.int32()), ("at", pa.int64()), ("role", pa.string())]))
    known = {TABLE: table, CHOICES: choice, LEFT: left, "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = {n: known[t] for n, t in made.items()}
    return df.mapInArrow(run, schema)


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults, gaps and the cheapest repair of every conversation of ``df``.

    Rows go by turn (nulls first); equal turns by role, then by SHA-256 of the text, so that equal rows are
    neighbours. A null role or text is one space, hence of no role or blank; a null conversation id is a
    conversation of its own; null turns count for no gap. Of equal rows (role and text) of a conversation
    all but the first are repeats, and they as well as blank rows are always deleted. Extra columns are not
    read. An empty table gives empty results; a conversation none of whose rows stays has no rows in ``rows``.

    ``report``: conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit. The audit is one
    string per conversation, a letter per row and insertion.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))
    rows = df.select(
        key.alias("key"),
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(NONE)).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(NONE)).alias("text"),
    ).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    placed = dense_index(rows, [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "at")
    first = placed.groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    coded = (
        placed.select("key", "conv_id", "at", "turn", "role", last_visible(F.col("text")).alias("last"))
        .join(first, "at", "left")
        .withColumn("code", row_code(F.col("role"), F.col("last"), F.col("first").isNull()))
        .withColumn("fault", F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated"))
    )
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    cut = coded.groupBy("key", F.shiftright("at", PIECE_BITS).alias("block")).agg(
        F.first("conv_id").alias("conv_id"),
        F.min("at").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "").alias("codes"),
        F.size(F.collect_set("turn")).cast("bigint").alias("turns"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
    )
    cut = freeze(cut, "pieces")
    bases = cut.groupBy("key").agg(F.min("block").alias("base"))
    indexed = cut.join(bases, "key").withColumn("idx", F.col("block") - F.col("base")).drop("block", "base")
    solve = lambda r: (flat(solved(r["codes"], r["idx"] == 0)), illegal_pairs(r["codes"]))
    pieces = freeze(_mapped(indexed, {"ways": TABLE, "illegal": "bigint"}, (), solve), "solved")
    levels = [pieces]
    most = pieces.agg(F.max("idx")).first()[0] or 0
    while most > 0:
        children = F.array_sort(F.collect_list(F.struct("idx", "ways"))).alias("children")
        joined = levels[-1].groupBy("key", F.shiftright("idx", FAN_BITS).alias("idx")).agg(children)
        combine = lambda r: (flat(stacks().combine([nested(c["ways"]) for c in r["children"]])),)
        levels.append(freeze(_mapped(joined, {"ways": TABLE}, (), combine), "combined"))
        most >>= FAN_BITS
    whole = _mapped(levels[-1].select("key", "idx", "ways"), {"start": "int", "end": "int", "cost": "bigint", "audit": "string"}, ("ways",), _best)
    whole = freeze(whole, "whole")
    chosen = whole.select("key", "idx", "start", "end")
    for level in levels[:0:-1]:
        follow = lambda r: ([{"idx": c["idx"], "start": a, "end": b} for c, (a, b) in zip(r["children"], _between(r))],)
        down = _mapped(level.select("key", "idx", "children").join(chosen, ["key", "idx"]), {"below": CHOICES}, ("idx", "children", "start", "end"), follow)
        chosen = down.select("key", F.inline("below"))
    edits = _mapped(pieces.select("key", "conv_id", "idx", "at", "codes", "ways").join(chosen, ["key", "idx"]), {"left": LEFT}, ("at", "codes", "ways", "start", "end"), _edits)
    edits = edits.select("key", "conv_id", "idx", F.inline("left")).withColumn("place", F.shiftleft("idx", 32) + F.col("seq"))
    edits = freeze(edits.select("key", "conv_id", "place", F.col("at").alias("row"), F.col("role").alias("written")), "edits")
    kept = edits.where("row is not null").join(placed.select(F.col("at").alias("row"), "role", "text"), "row")
    inserted = edits.where("row is null").select("conv_id", "key", "place", F.col("written").alias("role"), F.lit("").alias("text"))
    out = kept.select("conv_id", "key", "place", F.coalesce("written", "role").alias("role"), "text").unionByName(inserted)
    return Repair(_report(pieces, whole), out)


def _best(row: dict) -> tuple:
    end, cost, audit = stacks().best(nested(row["ways"]))
    return 0, end, cost, audit


def _between(row: dict) -> list[tuple[int, int]]:
    return stacks().tops_between([nested(c["ways"]) for c in row["children"]], row["start"], row["end"])


def _edits(row: dict) -> tuple:
    audit = nested(row["ways"])[row["start"]][row["end"]][1]
    left = stacks().rows_of(row["codes"], audit, row["start"])
    return ([{"seq": i, "at": None if at is None else row["at"] + at, "role": role} for i, (at, role) in enumerate(left)],)


def _report(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """Counts of a conversation: sums over its pieces, and what two pieces share at their border."""
    behind = pieces.select("key", (F.col("idx") - 1).alias("idx"), F.col("least").alias("next_turn"), F.substring("codes", 1, 1).alias("next_code"))
    border = pieces.join(behind, ["key", "idx"], "left")
    initial = lambda code: F.translate(code, CUT + DOOMED, SOUND + SOUND)
    pair = F.concat(initial(F.substring("codes", -1, 1)), initial(F.col("next_code")))
    wide = lambda c: c.cast("decimal(20,0)")
    counts = border.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        wide(F.max("most")).alias("most"),
        wide(F.min("least")).alias("least"),
        F.sum(F.col("turns") - F.when(F.col("most") == F.col("next_turn"), 1).otherwise(0)).alias("turns"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + F.when(pair.isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal"),
    )
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return counts.join(whole.select("key", "cost", "audit"), "key").select(
        "conv_id", "key", gaps.try_cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


def conversation_digests(rows: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of the ``role:text`` lines of each conversation.

    A digest reads its conversation from the first line to the last, so it is one stream; the rows are
    sorted (and spilled) by Spark and pass one batch at a time.
    """
    lines = rows.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "place").select("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for key, line in zip(batch.column("key").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
                if key == at:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], names=["key", "repaired_sha256"])
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    return lines.mapInArrow(run, "key string, repaired_sha256 string")


def damage_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by CRC-32 of ``conv:turn`` modulo 20; nulls are read as one space.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    fate = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    changed = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where(F.col("fate") != 0).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy")
    )
    return rows.drop("copy")
