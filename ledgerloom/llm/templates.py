"""Line dedup by a fixed-depth template tree (operator 6).

A line's tokens with a digit, an @ or a :// are variable fields. The line's leaf is named by its number of tokens and
its first tokens, variable fields as wildcards. In a leaf the distinct lines are taken in order: a line joins the
template it agrees with in most positions, if these are enough, and positions that differ become wildcards; else it
opens a template. A template that stands in enough documents is dropped from all of them.

Copies of a whole document are no evidence of a template: documents most of whose words stand in recurring lines have one
vote for each group of near copies (simhash.close_pairs) among them. So the lines that copies share with nothing but their
copies stay (near-duplicate removal deals with those), while a recurring line goes from copies too, and from pages that
have little else but are no copies of one another.

Only leaves with enough lines are looked into. A line is compared with the templates that an index of runs of tokens
finds, and no other template can agree with it in enough positions. A leaf of very many lines is no group of a task: it
is cut into runs of bounded size, each run gives its templates, and these are merged in the same way, in runs of another
order (from the line's start, then from each quarter of it on), until every leaf is one run or no order has merged
any more. Lines of fewer tokens than a minimum are left alone, as short sentences recur by chance.

Defined cases: a null text has no lines and stays null; an empty line is no template; repeated rows, equal in id and
text, are one document; a null doc_id is an id; a text all of whose lines go becomes empty; an empty table gives no
rows; other columns are kept by drop_templates().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import few_rows, texts_of
from ledgerloom.llm.simhash import close_pairs
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.ranking import ranked
from ledgerloom.plans.stash import SMALL_ROWS, small, stash

#: Leading tokens of a leaf; share of positions that must agree; documents of a recurring template; tokens of a line.
LEADING, AGREE, DOCUMENTS, TOKENS = 2, 0.7, 10, 3
#: Share of its words in recurring lines beyond which a document shares its vote with its near copies.
COPIED = 0.5
#: Lines, or templates, of a leaf that a task compares with one another; and the orders of fuller leaves.
RUN_LINES, ORDERS = 4096, 4
WILD = "<*>"

_VARIABLE = re.compile("[0-9@]|://")


def masked(line: str) -> list[str]:
    tokens, variable = line.split(), _VARIABLE.search
    return [WILD if variable(t) else t for t in tokens] if variable(line) else tokens


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def leaf_of(tokens: list[str]) -> int:
    return _hash(f"{len(tokens)} " + " ".join(tokens[:LEADING]))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """docs: (k, text). (k, leaf, mask, words, total): a row for each distinct line of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for k, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                seen: dict[int, list[int]] = {}
                total = 0
                for line in (text or "").split("\n"):
                    tokens = masked(line)
                    total += len(tokens)
                    if len(tokens) >= TOKENS:
                        m = _hash(" ".join(tokens))
                        if m in seen:
                            seen[m][1] += len(tokens)
                        else:
                            seen[m] = [leaf_of(tokens), len(tokens)]
                for m, (leaf, words) in seen.items():
                    for column, value in zip(out, (k, leaf, m, words, total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["k", "leaf", "mask", "words", "total"])

    return few_rows(docs).mapInArrow(run, "k long, leaf long, mask long, words long, total long")


def _line_texts(docs: DataFrame) -> DataFrame:
    """(leaf, mask, line): the distinct masked lines of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, tuple[int, str]] = {}
            for text in texts_of(batch.column(0)):
                for line in (text or "").split("\n"):
                    tokens = masked(line)
                    if len(tokens) >= TOKENS:
                        joined = " ".join(tokens)
                        if (m := _hash(joined)) not in seen:
                            seen[m] = (leaf_of(tokens), joined)
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in seen.values()], pa.int64()), pa.array(seen, pa.int64()), pa.array([v[1] for v in seen.values()], pa.string())], ["leaf", "mask", "line"])

    return few_rows(docs).select("text").mapInArrow(run, "leaf long, mask long, line string")


def _segments(tokens: int, agree: float) -> list[slice]:
    """Runs of positions behind the leading ones, one more than may differ: who agrees in enough positions agrees in all
    of one run."""
    differ = tokens - next(c for c in range(tokens + 1) if c / tokens >= agree)
    ends = np.linspace(LEADING, tokens, min(differ + 1, tokens - LEADING) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])] if differ < tokens - LEADING else []  # noqa: B905


def grow(lines: list[tuple[int, str]], agree: float = AGREE) -> tuple[list[tuple[int, int]], list[tuple[int, str]]]:
    """Of lines of one leaf, all of one length, in their order: (mask, template) of those that share a template, and
    (template, line) of all templates. A template is named by the mask of its first line; its line has wildcards."""
    ids: dict[str, int] = {WILD: 0}
    rows = np.array([[ids.setdefault(t, len(ids)) for t in line.split(" ")] for _, line in lines], np.int32)
    segments = _segments(rows.shape[1], agree)
    # the templates whose first lines have these tokens there; without a wildcard, as wildcards never agree
    index: dict[tuple[int, bytes], list[int]] = {}
    names: list[int] = []
    kept = np.zeros_like(rows)
    out, sizes = [], {}
    for (mask, _), row in zip(lines, rows, strict=True):
        keys = [(i, row[s].tobytes()) for i, s in enumerate(segments) if row[s].all()]
        near = sorted({x for k in keys for x in index.get(k, ())}) if segments else range(len(names))
        if near:
            near = np.fromiter(near, np.int64, len(near))
            same = ((kept[near] == row) & (row != 0)).mean(1)
            best = int(same.argmax())
            if same[best] >= agree:
                best = int(near[best])
                kept[best][kept[best] != row] = 0
                out.append((mask, names[best]))
                sizes[names[best]] = sizes.get(names[best], 1) + 1
                continue
        for k in keys:
            index.setdefault(k, []).append(len(names))
        kept[len(names)] = row
        names.append(mask)
        out.append((mask, mask))
    tokens = list(ids)
    return [(m, t) for m, t in out if t in sizes], [(name, " ".join([tokens[i] for i in row])) for name, row in zip(names, kept.tolist())]  # noqa: B905


def _ordered(line: str, order: int) -> str:
    """The line from one of its quarters on."""
    tokens = line.split(" ")
    at = len(tokens) * order // ORDERS
    return " ".join([*tokens[at:], *tokens[:at]])


def _grown(lines: DataFrame, order: int) -> DataFrame:
    """lines: (g, run, mask, line). From each run (mask, template) of lines that share one; and where run is not null, so
    the leaf has several, (g, template, line) of all templates."""
    dealt = lines.repartition("g", "run").sortWithinPartitions("g", "run", "line", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (None, None), []

        def flush() -> pa.RecordBatch:
            found, all_ = grow([(m, x) for _, m, x in sorted((_ordered(x, order), m, x) for m, x in held)]) if len(held) > 1 else ([], held)
            rows = [(m, t, None, None) for m, t in found] + [(None, t, at[0], x) for t, x in all_ if at[1] is not None]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)], ["mask", "template", "g", "line"])

        for batch in batches:
            for g, r, mask, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, r) != at:
                    if held:
                        yield flush()
                    at, held = (g, r), []
                held.append((mask, line))
        if held:
            yield flush()

    return dealt.mapInArrow(run, "mask long, template long, g long, line string")


def _templates(lines: DataFrame, run_lines: int) -> DataFrame:
    """lines: (g, mask, line). (mask, template) of the lines that share a template."""
    now, order, quiet, named = stash(lines.select("g", "mask", "line"), "leaves"), 0, 0, None
    while True:
        full = stash(now.groupBy("g").count().where(F.col("count") > run_lines).select("g"), "full")
        if full.isEmpty():
            dealt, merging = now.withColumn("run", F.lit(None).cast("long")), False
        else:
            # a line's place in its leaf is its place in the whole order less that of the leaf's first
            turned = now.join(small(full), "g", "left_semi").withColumn("order", _from_quarter("line", order))
            placed = stash(ranked(turned, "g", "order", "mask"), "placed")
            first = small(stash(placed.groupBy("g").agg(F.min("rank").alias("first")), "first"))
            runs = placed.join(first, "g").select("g", "mask", "line", F.floor((F.col("rank") - F.col("first")) / run_lines).alias("run"))
            dealt, merging = now.join(small(full), "g", "left_anti").withColumn("run", F.lit(None).cast("long")).unionByName(runs), True
        out = stash(_grown(dealt.select("g", "run", "mask", "line"), order), "grown")
        step = stash(out.where("mask IS NOT NULL").select("mask", "template"), "step")
        if named is None:
            named = step
        else:
            later = small(step.select(F.col("mask").alias("template"), F.col("template").alias("last")))
            firsts = step.join(named.select("mask"), "mask", "left_anti")
            named = stash(named.join(later, "template", "left").select("mask", F.coalesce("last", "template").alias("template")).unionByName(firsts), "named")
        if not merging:
            return named
        now = stash(out.where("g IS NOT NULL").select("g", F.col("template").alias("mask"), "line"), "leaves")
        quiet = 0 if step.join(now.select(F.col("mask").alias("template")), "template", "left_semi").where("mask <> template").take(1) else quiet + 1
        if quiet == ORDERS:
            return named
        order = (order + 1) % ORDERS


def _from_quarter(line: str, order: int) -> Column:
    """_ordered() as a column."""
    tokens = F.split(line, " ", -1)
    at = F.floor(F.size(tokens) * order / ORDERS).cast("int")
    return F.concat_ws(" ", F.slice(tokens, at + 1, F.size(tokens)), F.slice(tokens, F.lit(1), at))


def recurring(docs: DataFrame, documents: int = DOCUMENTS, run_lines: int = RUN_LINES) -> tuple[DataFrame, DataFrame]:
    """docs: (k, text). (mask), the masked lines that are to be dropped wherever they stand, and (k, mask, ...) of all
    lines that recur."""
    lines = stash(_lines(docs).distinct(), "lines")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("mask").alias("a"), F.max("mask").alias("b"))
    full = stash(leaves.where((F.col("n") >= documents) & (F.col("a") != F.col("b"))).select("leaf"), "leaves")
    texts = _line_texts(docs).join(small(full), "leaf").select(F.col("leaf").alias("g"), "mask", "line").dropDuplicates(["mask"])
    grown = _templates(texts, run_lines)
    named = stash(lines.join(small(grown), "mask", "left").select("k", "mask", "words", "total", F.coalesce("template", "mask").alias("t")).withColumn("voter", F.col("k")), "named")

    def often(rows: DataFrame) -> DataFrame:
        return stash(rows.groupBy("t").agg(F.count_distinct("voter").alias("n")).where(F.col("n") >= documents).select("t"), "often")

    rows = stash(named.join(small(often(named)), "t"), "recurring")
    full = rows.groupBy("k").agg(F.sum("words").alias("w"), F.max("total").alias("total")).where(F.col("w") > COPIED * F.col("total")).select("k")
    copies = _copies(docs, stash(full, "full"))
    voted = often(rows if copies is None else rows.drop("voter").join(small(copies), "k", "left").withColumn("voter", F.coalesce("voter", "k")))
    return stash(rows.join(small(voted), "t", "left_semi").select("mask").distinct(), "dropped"), rows


def _copies(docs: DataFrame, full: DataFrame) -> DataFrame | None:
    """docs: (k, text), full: (k). (k, voter): the documents of full that have near copies among them; voter names the
    group."""
    if full.isEmpty():
        return None
    own = docs.join(small(full), "k", "left_semi").select("k", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    first = stash(own.groupBy("k").agg(F.min("h").alias("h")), "texts")
    near = stash(connected_components(close_pairs(own.select("h", "text"))).withColumnRenamed("node", "h"), "copies")
    return stash(first.join(small(near), "h", "left").select("k", F.coalesce("component", "h").alias("voter")), "voters")


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, set_lines: int = SMALL_ROWS, run_lines: int = RUN_LINES) -> DataFrame:
    """The documents in their own columns, the text without recurring lines, and __lines and __dropped (line numbers from 0).

    A line goes if its mask is one of those to be dropped. Up to set_lines masks are a broadcast set (some 70 bytes each in
    a worker), and texts are not shuffled; of more, each document gets its own by a join.
    """
    key = _key(id_col, text_col)
    dropped, rows = recurring(docs.select(key.alias("k"), F.col(text_col).alias("text")), documents, run_lines)
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    place, spark = docs.columns.index(text_col), docs.sparkSession
    if dropped.count() <= set_lines:
        known = spark.sparkContext.broadcast(frozenset(r.mask for r in dropped.collect()))
        own, masks_of = docs, None
    else:
        known = None
        gone = stash(rows.join(dropped, "mask", "left_semi").groupBy("k").agg(F.collect_set("mask").alias("masks")), "gone")
        own = docs.withColumn("__k", key).join(gone.select(F.col("k").alias("__k"), F.col("masks").alias("__masks")), "__k", "left").select(*docs.columns, "__masks")
        masks_of = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone_lines = [], [], []
            all_masks = [known.value] * batch.num_rows if masks_of is None else batch.column(masks_of).to_pylist()
            for text, masks in zip(texts_of(batch.column(place)), all_masks, strict=True):
                lines, cut = text.split("\n") if text else [], []
                if masks:
                    masks = masks if masks_of is None else set(masks)
                    tokens = [masked(x) for x in lines]
                    cut = [i for i, t in enumerate(tokens) if len(t) >= TOKENS and _hash(" ".join(t)) in masks]
                if cut:
                    gone = set(cut)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                texts.append(text)
                counts.append(len(lines))
                gone_lines.append(cut)
            columns = list(batch.columns[: len(kinds)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone_lines, pa.list_(pa.int32()))], [*(n for n, _ in kinds), "__lines", "__dropped"])

    return few_rows(own).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in [*kinds, ("__lines", "long"), ("__dropped", "array<int>")]))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_templates(docs)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"), F.col("__dropped").alias("dropped"), F.length("text").cast("long").alias("n_chars"), "text")
