"""Line dedup with a log-template tree of fixed depth.

A line's tokens are its runs of bytes other than ASCII white space; tokens with a digit
are variable fields (``<*>``). The tree goes by token count, then by the first ``depth``
tokens. Within such a leaf a token is kept at its place if at least ``min_docs``
(document, line) pairs of the leaf have it there; other places become variable. If the
kept tokens are at least ``similarity`` of the line, the result is the line's template,
else the line stands for itself. Templates that occur in ``min_docs`` documents recur:
their first line (smallest doc_id, then line number) stays, all others are dropped.

The leaves do not depend on the order in which lines come, so they are parsed in
parallel. A first pass counts documents per leaf in a table of fixed size; only lines
whose leaf may reach ``min_docs`` (the table only ever lets too many through) are moved.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from revlens.llm.text import bounded_batches, stage

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 10
TABLE_BITS = 24
VARIABLE = "<*>"
_DIGIT = re.compile(rb"[0-9]")


def parse(line: bytes, depth: int) -> tuple[list[bytes], bytes] | None:
    """(tokens with variable fields masked, leaf) of a line; None if it is blank."""
    tokens = line.split()
    if not tokens:
        return None
    if _DIGIT.search(line):
        tokens = [VARIABLE.encode() if _DIGIT.search(t) else t for t in tokens]
    return tokens, b"%d %b" % (len(tokens), b" ".join(tokens[:depth]))


def _hot_leaves(docs: DataFrame, depth: int, min_docs: int) -> np.ndarray:
    """Bit table (of fixed size) of the leaf buckets that min_docs documents have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[int] = []
            for text in b.column(0).to_pylist():
                own = set()
                for line in (text or "").encode("utf-8", "replace").split(b"\n"):
                    head = line.split(None, depth)
                    if head:
                        # cheaper than parse(): only the leading tokens are looked at
                        n = len(line.split())
                        lead = [VARIABLE.encode() if _DIGIT.search(t) else t for t in head[:depth]]
                        own.add(zlib.crc32(b"%d %b" % (n, b" ".join(lead))) >> (32 - TABLE_BITS))
                out += own
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out, pa.int32())})
    hot = (docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "bucket int").groupBy("bucket").count()
           .where(F.col("count") >= min_docs)
           .groupBy(F.shiftright("bucket", 6).alias("word"))
           .agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits")).toPandas())
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[hot["word"].to_numpy()] = hot["bits"].to_numpy()
    return table.view(np.uint8)


def _is_hot(table: bytes, bucket: int) -> bool:
    return bool(table[bucket >> 3] >> (bucket & 7) & 1)


def candidate_lines(docs: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(doc_id, i, h, leaf, masked, raw) of the lines whose leaf may recur; raw has the
    line's own tokens."""
    # looked up bit by bit: a byte a bit would be eight times the table in every worker
    shared = docs.sparkSession.sparkContext.broadcast(_hot_leaves(docs, depth, min_docs).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
                    head = line.split(None, depth)
                    if not head:
                        continue
                    n = len(head) if len(head) <= depth else depth + len(head[depth].split())
                    lead = [VARIABLE.encode() if _DIGIT.search(t) else t for t in head[:depth]]
                    leaf = b"%d %b" % (n, b" ".join(lead))
                    if _is_hot(hot, zlib.crc32(leaf) >> (32 - TABLE_BITS)):
                        tokens, _ = parse(line, depth)
                        rows.append((doc, i, zlib.crc32(line), leaf.decode(), b" ".join(tokens).decode(), b" ".join(line.split()).decode()))
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "i", "h", "leaf", "masked", "raw"])
    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, i int, h long, leaf string, masked string, raw string"))


def with_templates(lines: DataFrame, depth: int, similarity: float, min_docs: int) -> DataFrame:
    """lines plus template."""
    distinct = lines.select("leaf", "masked", "doc_id").distinct().groupBy("leaf", "masked").agg(F.count("*").alias("n"))
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("total")).where(F.col("total") >= min_docs)
    distinct = stage(distinct.join(leaves.select("leaf"), "leaf").withColumn("kind", F.monotonically_increasing_id()), "line-kinds")
    # A row for each token of a line: the planner takes them to be as many as the lines and would
    # broadcast them, so they go by the number of their kind, and no join may broadcast a side.
    # The leading tokens are those of the whole leaf, so they are always kept.
    places = (distinct.select("leaf", "kind", "n", F.posexplode(F.split("masked", " ")).alias("place", "token"))
              .where((F.col("place") >= depth) & (F.col("token") != VARIABLE)))
    kept = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    fixed = (places.join(kept.select("leaf", "place", "token").hint("merge"), ["leaf", "place", "token"])
             .groupBy("kind").agg(F.collect_set("place").alias("fixed")))
    tokens = F.split("masked", " ")
    general = F.transform(tokens, lambda t, i: F.when((i < depth) | F.array_contains(F.coalesce("fixed", F.array().cast("array<int>")), i), t)
                          .otherwise(F.lit(VARIABLE)))
    shapes = (distinct.join(fixed.hint("merge"), "kind", "left").withColumn("general", general)
              .withColumn("share", F.size(F.filter("general", lambda t: t != VARIABLE)) / F.size("general"))
              .select("leaf", "masked", F.when(F.col("share") >= similarity, F.array_join("general", " ")).alias("general")))
    # staged, so that a line kind that many documents share is a skewed join of two
    # exchanges, which adaptive execution splits
    shapes = stage(shapes, "shapes").hint("merge")
    # T for a template, L for a line that stands for itself
    return (lines.join(shapes, ["leaf", "masked"])
            .withColumn("template", F.coalesce(F.concat(F.lit("T "), "general"), F.concat(F.lit("L "), "raw"))).drop("general"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, i, h, template) of the lines to drop. Repeated templates take next to no room in
    files, by which the planner sizes them: no join by template may broadcast a side."""
    lines = stage(candidate_lines(docs, depth, min_docs), "lines")
    lines = stage(with_templates(lines, depth, similarity, min_docs).select("doc_id", "i", "h", "template"), "templates")
    per_doc = lines.groupBy("template", "doc_id").agg(F.min("i").alias("i"))
    recurring = (per_doc.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
                 .where(F.col("n") >= min_docs).drop("n"))
    firsts = (per_doc.join(recurring.hint("merge"), "template").where("doc_id = first_doc")
              .select("template", "first_doc", F.col("i").alias("first_i")))
    firsts = stage(firsts, "firsts")
    return lines.join(firsts.hint("merge"), "template").where("doc_id <> first_doc OR i <> first_i").select("doc_id", "i", "h", "template")


def deduplicate(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs(doc_id integer, text, ...) plus kept_text, n_lines, n_dropped.

    Lines end at line feeds; kept lines are joined by them unchanged. Blank lines stay.
    A null text stays null with no line; an empty one is one blank line. Documents with
    a null doc_id are neither counted nor changed. Rows that repeat a doc_id count as
    one document: equal lines at one line number are treated alike. Columns of docs
    named like the three results are replaced.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("kept_text", "n_lines", "n_dropped")
    gone = (dropped_lines(base, depth, similarity, min_docs).groupBy(F.col("doc_id").alias("__doc"))
            .agg(F.collect_set(F.struct("i", "h")).alias("__gone")))
    joined = base.join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")

    @pandas_udf("kept_text string, n_lines int, n_dropped int")
    def cut(text, gone):
        out = []
        for t, g in zip(text, gone):
            if t is None:
                out.append((None, 0, 0))
                continue
            lines = t.split("\n")
            if g is None:
                out.append((t, len(lines), 0))
                continue
            marks = {(x["i"], x["h"]) for x in g}
            kept = [x for i, x in enumerate(lines) if (i, zlib.crc32(x.encode("utf-8", "replace"))) not in marks]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped"])
    # a filter on its results would be pushed below it with a copy of it: a second pass of the
    # texts through a second Python worker of each task; not below what may change from call to call
    out = joined.withColumn("__cut", cut.asNondeterministic()("text", "__gone"))
    return out.select(*base.columns, "__cut.kept_text", "__cut.n_lines", "__cut.n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
toks AS (SELECT doc_id, i, line, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts
         FROM lines WHERE len(raw) > 0 AND doc_id IS NOT NULL),
leafed AS (SELECT *, (len(ts), ts[1:3]) AS leaf FROM toks),
kinds AS (SELECT leaf, ts, count(DISTINCT doc_id) AS n FROM leafed GROUP BY ALL),
places AS (SELECT leaf, ts, n, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM kinds),
kept AS (SELECT leaf, p, t FROM places WHERE t <> '<*>' GROUP BY ALL HAVING sum(n) >= 10),
shaped AS (SELECT places.leaf, places.ts, list(CASE WHEN places.p <= 3 OR kept.t IS NOT NULL THEN places.t ELSE '<*>' END ORDER BY places.p) AS g
           FROM places LEFT JOIN kept ON places.leaf = kept.leaf AND places.p = kept.p AND places.t = kept.t GROUP BY ALL),
templ AS (SELECT doc_id, i, CASE WHEN len(list_filter(g, lambda t: t <> '<*>')) / len(g) >= 0.8 THEN 'T ' || array_to_string(g, ' ')
                                 ELSE 'L ' || array_to_string(raw, ' ') END AS template
          FROM leafed JOIN shaped USING (leaf, ts)),
rec AS (SELECT template FROM templ GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY template ORDER BY doc_id, i) AS k FROM templ SEMI JOIN rec USING (template)),
gone AS (SELECT doc_id, i FROM ranked WHERE k > 1),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(ls) - coalesce(n, 0), 0) AS INTEGER) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""
