"""Main text of web pages by consensus host paths.

Each page names the container that holds most of its content, as a path of tags and classes with digits
generalised. Spark counts the votes per host; the paths with the most votes win, and every page of the
host is extracted again below the first winning path that holds most of its content. A page without any
of them falls back to its own container. Where a page has no container but its body, the host's votes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventgrove.llm.columns import sub_batches, with_arrow_columns
from eventgrove.llm.pages import Page
from eventgrove.plans.scratch import freeze

#: Winning paths of a host: at most this many, each with at least this share (percent) of the best one's votes.
WINNERS, LEAST_SHARE = 3, 10


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without "www."; a null or odd URL has the empty host."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def is_shell(path: str) -> bool:
    """Whether a path names no container inside the page."""
    return path.rpartition("/")[2].split(".")[0] in ("", "html", "body")


def winning_paths(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the winning paths of each host, the best first.

    One vote per page with content. A vote is a narrow row that is counted before it is shuffled, so a
    host with a third of all pages is no large group.
    """

    def best(values: pa.Array) -> list[pa.Array]:
        return [pa.array([Page(v).best_container()[0] if v else "" for v in values.to_pylist()], type=pa.string())]

    pages = df.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    votes = with_arrow_columns(pages, "html", {"path": T.StringType()}, best, keep=["host"]).where("path != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.select("*", F.row_number().over(order).alias("place"), F.max("votes").over(Window.partitionBy("host")).alias("most"))
    kept = ranked.where((F.col("place") <= WINNERS) & (F.col("votes") * 100 >= F.col("most") * LEAST_SHARE))
    return kept.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract_main_text(df: DataFrame, url: str = "url", html: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the main text of each page: its blocks, joined by an empty line.

    * A null or empty page has an empty text, as has one whose text is all boilerplate. Whole pages are
      read. Repeated rows vote and are extracted one by one. A column already named ``text`` is replaced.
    * White space inside a block, no-break spaces included, becomes one space; ``br`` is white space.
    """
    winners = freeze(winning_paths(df, url, html), "paths")  # a written table: the join below knows its size
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() != text.lower()]
    pages = df.select(F.struct(*kept).alias("row"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = pages.join(winners, "host", "left").select("row", "html", "paths")
    row_type = joined.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "html"):
            texts = []
            for page, paths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                blocks: list[str] = []
                if page:
                    tree = Page(page)
                    own = tree.best_container()[0]
                    for path in paths or []:
                        if path in tree.paths and (is_shell(own) or own == path or tree.covers(path)):
                            blocks = tree.blocks(path, tree.container if own == path else 0)
                        if blocks:
                            break
                    blocks = blocks or tree.blocks(own or None, tree.container)
                texts.append("\n\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["row", "text"])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("text", T.StringType())])
    made = joined.mapInArrow(run, schema)
    return made.select(*(F.col(f"row.`{c}`") for c in kept), F.col("text").alias(text))
