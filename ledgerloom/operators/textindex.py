"""A word index that is kept up to date: segments, delete marks by source, and merges.

Each change writes one segment: postings (term, doc, source, tf, length, segment) laid out by range of (term, doc), the
lengths of its documents, and marks (source, before): the source's rows in segments before that number no longer count.
Segments, marks and totals become visible together, as a version of the store. A search joins the postings of its terms
with the marks, so it reads no text and no segment is changed; its scores are those of an index built from scratch.
merge() writes the living rows of all segments as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import B, K1, expanded_terms, tokens, top
from ledgerloom.plans.stash import small, stash
from ledgerloom.sources import versions as V

#: Characters that a paragraph must have, its heading's marks left out.
LEAST = 8
# The labels that a reading may give, and what one without a quotation is worth at the most.
LABELS = ("EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP")
UNQUOTED = 0.4


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def ingested(docs: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """(id, seq, source_file, raw_text): the paragraphs of each source's text, parted by blank lines and before headings,
    from 1; the id is a hash of source, place and text, so the same text gives the same ids. Null texts have none."""
    parts = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n|\n(?=#)")
    kept = F.filter(F.transform(parts, _stripped), lambda p: F.length(_stripped(F.regexp_replace(p, r"^#+\s*", ""))) >= LEAST)
    own = docs.select(F.col(source).alias("source_file"), F.posexplode(kept).alias("seq", "raw_text")).withColumn("seq", F.col("seq") + 1)
    mark = F.concat_ws(":", "source_file", F.col("seq").cast("string"), "raw_text")
    return own.select(F.substring(F.sha1(mark), 1, 16).alias("id"), "seq", "source_file", "raw_text")


_POSTING = ("term", "doc", "source", "tf", "length", "segment")


def _living(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Rows whose source has no later mark; a mark is a row of fixed width for each source that was ever replaced."""
    if marks is None:
        return rows
    last = small(stash(marks.groupBy(F.col("source").alias("source")).agg(F.max("before").alias("before")), "marks"))
    return rows.join(last, rows["source"].eqNullSafe(last["source"]), "left").where(F.col("before").isNull() | (F.col("segment") >= F.col("before"))).select(*(rows[c] for c in rows.columns))


def _sorted(postings: DataFrame) -> DataFrame:
    return postings.select(*_POSTING).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")


def _totals(lengths: DataFrame | None, marks: DataFrame | None) -> dict:
    if lengths is None:
        return {"docs": 0, "length": 0}
    r = _living(lengths, marks).agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    return {"docs": r["docs"], "length": r["length"]}


def replace_sources(spark: SparkSession, path: str, docs: DataFrame, gone: DataFrame | None = None, doc: str = "doc_id", source: str = "source", text: str = "text") -> V.Manifest:
    """One more segment: the sources in docs have these documents and no others from now on; those in gone (source) have
    none. Null texts are empty documents, a null source is a source. If another writer commits first, this is a Conflict."""
    m = V.manifest(spark, path)
    segment = m.version + 1
    own = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    words = own.select("doc", "source", F.size("t").cast("long").alias("length"), F.explode_outer("t").alias("term"))
    tf = stash(words.groupBy("doc", "source", "length", "term").agg(F.count("*").alias("tf")).withColumn("segment", F.lit(segment)), "segment")
    lengths = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("length"), F.lit(segment).alias("segment"))
    marks = own.select("source") if gone is None else own.select("source").unionByName(gone.select("source"))
    marks = marks.distinct().withColumn("before", F.lit(segment))
    names = {"postings": V.part(_sorted(tf.where("term IS NOT NULL")), path, "postings"), "lengths": V.part(lengths, path, "lengths"), "marks": V.part(marks, path, "marks")}
    draft = V.Manifest(0, {k: [*m.tables.get(k, []), v] for k, v in names.items()})
    return V.commit(spark, path, m, draft.tables, _totals(V.table(spark, path, draft, "lengths"), V.table(spark, path, draft, "marks")))


def merge(spark: SparkSession, path: str) -> V.Manifest:
    """One segment with all living rows; older marks no longer matter to it, later ones do."""
    m = V.manifest(spark, path)
    marks, made = V.table(spark, path, m, "marks"), {"marks": []}
    for name in ("postings", "lengths"):
        rows = V.table(spark, path, m, name)
        if rows is not None:
            rows = _living(rows, marks).withColumn("segment", F.lit(m.version + 1))
            made[name] = [V.part(_sorted(rows) if name == "postings" else rows, path, name)]
    return V.commit(spark, path, m, made, m.facts)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, synonyms: DataFrame | None = None, version: int | None = None, query: str = "query_id", query_text: str = "text") -> DataFrame | None:
    """(query, rank, doc, score) in a version of the index: the k best documents by BM25, scores rounded to nine places,
    ties to the smaller document. None for an index without a segment."""
    m = V.manifest(spark, path, version)
    posted = V.table(spark, path, m, "postings")
    if posted is None:
        return None
    terms = stash(expanded_terms(queries, synonyms, query, query_text), "terms")
    asked = small(stash(terms.select("term").distinct(), "asked"))
    tf = stash(_living(posted.join(asked, "term", "left_semi"), V.table(spark, path, m, "marks")), "postings")
    n, avg = m.facts["docs"], m.facts["length"] / m.facts["docs"] if m.facts["length"] else 1.0
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").select(query, "term", F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avg))
    scored = tf.join(small(stash(weighed, "weighed")), "term").groupBy(query, "doc").agg(F.round(F.sum(part), 9).alias("score"))
    return top(scored, query, "doc", "score", k)


def quoted_label(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, trade_mode, confidence, evidence) of readings (query, trade_mode, confidence, evidence) of the paragraphs
    found (query, seq, raw_text): a label that is none is unknown; evidence must stand in the paragraphs, whole and as it
    is; a label without it is worth UNQUOTED at the most. A query without a reading is unknown with 0."""
    blob = hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw_text"))), lambda x: F.coalesce(x["raw_text"], F.lit(""))), "\n").alias("__blob"))  # the few best hits of a query
    own = blob.join(answers, query, "left")
    mode = F.upper(F.coalesce(F.col("trade_mode"), F.lit("")))
    known, said = mode.isin(*LABELS), F.coalesce(F.col("evidence"), F.lit(""))
    evidence = F.when(F.contains("__blob", said), said).otherwise("")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.0))))
    return own.select(query, F.when(known, mode).otherwise("unknown").alias("trade_mode"), F.when(known & (evidence == ""), F.least(confidence, F.lit(UNQUOTED))).otherwise(confidence).alias("confidence"), evidence.alias("evidence"))
