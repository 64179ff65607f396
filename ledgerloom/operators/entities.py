"""Which business a document belongs to: aliases, their owners, similar spellings, inheritance and components."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import compact_id, normalize_id
from ledgerloom.operators.components import connected_components
from ledgerloom.plans.stash import small, stash

#: Parts of an identifier that may stand apart in a text.
PARTS = 4


def alias(c: Column) -> Column:
    """Upper case without dashes, underscores and white space."""
    return F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"[-_\s]", "")


def alias_index(population: DataFrame, business: str = "business_id", orders: str = "order_numbers", invoices: str = "invoice_numbers") -> DataFrame:
    """(alias, kind, value, owner, owners): a row for each alias. kind and value are the least; owner is its business, or
    the least of several; owners counts them, so an alias with more than one is ambiguous. A business is its own alias."""
    as_rows = lambda c, kind: population.select(F.col(business).alias("owner"), F.explode(c).alias("value")).withColumn("kind", F.lit(kind))
    rows = population.select(F.col(business).alias("owner"), F.col(business).alias("value"), F.lit("business_id").alias("kind"))
    rows = rows.unionByName(as_rows(orders, "order_number")).unionByName(as_rows(invoices, "invoice_number"))
    rows = rows.select("owner", "kind", F.trim(F.col("value").cast("string")).alias("value")).withColumn("alias", alias(F.col("value"))).where("owner IS NOT NULL AND alias <> ''")
    return rows.groupBy("alias").agg(F.min("kind").alias("kind"), F.min("value").alias("value"), F.min("owner").alias("owner"), F.count_distinct("owner").alias("owners"))


def tokens_as_aliases(text: Column) -> Column:
    """Every run of up to four neighbouring alphanumeric tokens of a text, joined; runs do not cross other characters."""
    pieces = F.regexp_extract_all(F.upper(text), F.lit(r"[A-Z0-9]+(?:[-_\s]+[A-Z0-9]+)*"), F.lit(0))
    runs = lambda ts: F.flatten(F.transform(ts, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PARTS), F.size(ts) - i)), lambda n: F.array_join(F.slice(ts, i + 1, n), ""))))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: runs(F.split(p, r"[-_\s]+")))))


def safe_in_text(value: Column, kind: Column) -> Column:
    """Whether an alias is no ordinary number: four characters with a letter, or eight digits of an invoice number."""
    return F.when(value.rlike("[A-Z]"), F.length(value) >= 4).otherwise((F.length(value) >= 8) & (kind == "invoice_number"))


def similar(detected: DataFrame, index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, detected, alias): aliases with the same letters in front that differ by one edit at most, for review.

    Two words one edit apart share the word itself or one of its forms with a character less, so they meet by a hash of
    that; the meeting is then verified. Words meet, each once, and are laid over the documents afterwards."""
    forms = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, F.length(c))))))
    letters = lambda c: F.regexp_extract(c, "^[A-Z]+", 0)
    keyed = lambda df, c: df.select(c, F.explode(F.transform(forms(F.col(c)), lambda x: F.xxhash64(letters(F.col(c)), x))).alias("form"))
    own = detected.select(doc, F.explode("found").alias("detected")).where(letters(F.col("detected")) != "")
    known = index.select("alias").where(letters(F.col("alias")) != "").distinct()
    met = keyed(own.select("detected").distinct(), "detected").join(keyed(known, "alias"), "form").where((letters(F.col("detected")) == letters(F.col("alias"))) & (F.levenshtein("detected", "alias", 1) >= 0))
    return own.join(met.select("detected", "alias").distinct(), "detected").select(doc, "detected", "alias").distinct()


def resolve(docs: DataFrame, index: DataFrame, doc: str = "doc_id", exact: str = "exact", found: str = "found") -> DataFrame:
    """(doc, status, business_id): MATCHED with one owner over all evidence; several owners are a CONFLICT if any evidence
    has one owner only, else AMBIGUOUS_ALIAS; without evidence SIMILAR_CANDIDATE or UNASSIGNED.

    exact: declared values and fields as aliases; found: aliases read from texts, of which only safe ones count.
    """
    told = docs.select(doc, F.explode(F.array_distinct(exact)).alias("alias"), F.lit(True).alias("told"))
    read = docs.select(doc, F.explode(F.array_distinct(found)).alias("alias"), F.lit(False).alias("told"))
    met = told.unionByName(read).join(index.select("alias", "kind", "owner", "owners"), "alias").where(F.col("told") | safe_in_text(F.col("alias"), F.col("kind")))
    got = met.groupBy(doc).agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.max("owners").alias("most"), F.min("owners").alias("least"))
    near = similar(docs.select(doc, found), index, doc).select(doc).distinct().withColumn("near", F.lit(True))
    wide = docs.select(doc).join(got, doc, "left").join(near, doc, "left")
    many = (F.col("a") != F.col("b")) | (F.col("most") > 1)
    status = F.when(F.col("a").isNull(), F.when(F.col("near"), "SIMILAR_CANDIDATE").otherwise("UNASSIGNED")).when(~many, "MATCHED").when(F.col("least") == 1, "CONFLICT").otherwise("AMBIGUOUS_ALIAS")
    return wide.select(doc, status.alias("status"), F.when(status == "MATCHED", F.col("a")).alias("business_id"))


def sample_scope(resolved: DataFrame, families: DataFrame, doc: str = "doc_id", prefix: str = "prefix", business: str = "business_id") -> DataFrame:
    """Adds scope to resolved documents: IN_SAMPLE, MIXED_SCOPE (evidence for several), OUT_OF_SAMPLE (unresolved, but of a
    family of identifiers that the sample has), UNRESOLVED. families: (prefix)."""
    known = stash(families.select(F.col(prefix).alias("__prefix")).distinct().withColumn("__known", F.lit(True)), "families")
    out = resolved.join(small(known), F.col(prefix) == F.col("__prefix"), "left")
    scope = F.when(F.col("status") == "MATCHED", "IN_SAMPLE").when(F.col("status").isin("CONFLICT", "AMBIGUOUS_ALIAS"), "MIXED_SCOPE").when(F.col("__known"), "OUT_OF_SAMPLE").otherwise("UNRESOLVED")
    return out.withColumn("scope", scope).drop("__prefix", "__known")


def inherit(anchors: DataFrame, references: DataFrame, doc: str = "doc_id", ref: str = "ref", business: str = "business_id", most_rounds: int | None = None) -> DataFrame:
    """(doc, business, status) of every document that has a reference: MATCHED at once (anchors), INHERITED or CONFLICT.

    In each round a document without a business takes that of the documents it shares an exact reference with, if they
    have one business; if they have more, it is in conflict for good. Rounds go on until nothing changes; if there are
    more than most_rounds, it raises. A reference's
    owners are kept as their least and largest, so a hot reference is two values, not a list.
    """
    refs = stash(references.select(F.col(doc).alias("d"), F.col(ref).alias("r")).where("r IS NOT NULL").distinct(), "refs")
    known = stash(anchors.select(F.col(doc).alias("d"), F.col(business).alias("b"), F.lit("MATCHED").alias("s")), "known")
    for at in itertools.count():
        owners = stash(refs.join(known.where("b IS NOT NULL"), "d").groupBy("r").agg(F.min("b").alias("lo"), F.max("b").alias("hi")), "owners")
        open_refs = refs.join(known, "d", "left_anti")
        new = open_refs.join(owners, "r").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        one = F.col("lo") == F.col("hi")
        new = stash(new.select("d", F.when(one, F.col("lo")).alias("b"), F.when(one, "INHERITED").otherwise("CONFLICT").alias("s")), "inherited")
        if new.isEmpty():
            break
        if most_rounds is not None and at >= most_rounds:
            raise RuntimeError(f"references go on after {most_rounds} rounds")
        known = stash(known.unionByName(new), "known")
    return known.select(F.col("d").alias(doc), F.col("b").alias(business), F.col("s").alias("status"))


#: Digits of a cut-off key that is looked for in all jobs.
LEAST_DIGITS = 5


def key_merges(keys: DataFrame, key: str = "key", job: str | None = None) -> DataFrame:
    """(src, dst): pairs of normalised keys that name one business: a key and those of its family that it is a cut-off
    beginning of (dashes aside), and, where a job has one order number (SO) and one contract number (HT), these two.

    With jobs, a key is a beginning of keys of its own job only. Without, it must have LEAST_DIGITS digits, so that a scan
    cut off after "SO" or "SO25" does not make one business of all. A key meets the others by its beginnings, a few for
    each, so no two keys are compared that share none.
    """
    n = normalize_id(F.col(key))
    own = stash(keys.select(n.alias("key"), compact_id(F.col(key)).alias("id"), *([F.col(job).alias("job")] if job else [])).where("id <> ''"), "merge_keys")
    by = ["job"] if job else []
    ids = own.select("key", "id", *by).distinct()
    starts = ids.where(F.length("id") > 2).select(*by, F.col("key").alias("dst"), F.explode(F.sequence(F.lit(2), F.length("id") - 1)).alias("n"), "id")
    starts = starts.select(*by, "dst", F.left("id", F.col("n")).alias("id"))
    if job is None:
        starts = starts.where(F.length(F.regexp_replace("id", "[^0-9]", "")) >= LEAST_DIGITS)
    cut_off = starts.join(ids.withColumnRenamed("key", "src"), ["id", *by]).select("src", "dst").distinct()
    if job is None:
        return cut_off
    kind = F.when(F.startswith("id", F.lit("SO")), "so").when(F.contains("id", F.lit("HT")), "ht")
    sole = own.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("job", "kind").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    sole = sole.where("a = b").groupBy("job").agg(F.min(F.when(F.col("kind") == "so", F.col("a"))).alias("src"), F.min(F.when(F.col("kind") == "ht", F.col("a"))).alias("dst"))
    return cut_off.unionByName(sole.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"))


def business_groups(keys: DataFrame, doc: str = "doc_id", key: str = "key", merges: DataFrame | None = None) -> DataFrame:
    """(doc, group): documents that share keys, directly or through others, are one group. It is named by its preferred
    key: order numbers (SO) before others, then the longest, then the largest. merges: further pairs of keys that are one
    (key_merges())."""
    own = keys.select(F.concat(F.lit("d:"), F.col(doc).cast("string")).alias("src"), F.concat(F.lit("k:"), normalize_id(F.col(key))).alias("dst"), F.col(doc).alias("doc"), normalize_id(F.col(key)).alias("key")).where("key <> ''")
    own = stash(own.distinct(), "keys")
    edges = own.select("src", "dst")
    if merges is not None:
        edges = stash(edges.unionByName(merges.select(F.concat(F.lit("k:"), "src").alias("src"), F.concat(F.lit("k:"), "dst").alias("dst"))), "merged_keys")
    nodes = stash(connected_components(edges), "groups")
    named = own.join(nodes, own["src"] == nodes["node"]).select("doc", "key", "component")
    best = F.struct(F.startswith("key", F.lit("SO")), F.length("key"), "key")
    names = stash(named.groupBy("component").agg(F.max_by("key", best).alias("group")), "names")
    return named.select("doc", "component").distinct().join(names, "component").select(F.col("doc").alias(doc), "group")


def group_precedence(manual: Column, sample: Column, component: Column) -> Column:
    """A group set by hand, else the sample's business, else the component."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(manual), blank(sample), blank(component))


def in_population(chains: DataFrame, population: DataFrame, chain: str = "chain_id", business: str = "business_id") -> DataFrame:
    """Adds in_population: true or false, as written or compact; null for every row if there is no population."""
    ids = population.select(compact_id(F.col(business)).alias("__id")).where("__id <> ''").distinct().withColumn("__in", F.lit(True))
    there = not ids.isEmpty()
    out = chains.join(ids, compact_id(F.col(chain)) == F.col("__id"), "left")
    return out.withColumn("in_population", F.coalesce("__in", F.lit(False)) if there else F.lit(None).cast("boolean")).drop("__id", "__in")


def merge_exceptions(old: DataFrame, new: DataFrame, accepted: DataFrame, exception: str = "exception_id", name: str = "file_name") -> DataFrame:
    """Old and new exceptions by their id: of one that is in both the new row counts, and old ones of a file that has been
    accepted since are cleared."""
    kept = old.join(accepted.select(name).where(F.col(name) != "").distinct(), name, "left_anti").select(*old.columns)
    return kept.join(new.select(exception), exception, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
