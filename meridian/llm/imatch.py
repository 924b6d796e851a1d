"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations only.

A term (run of letters and digits, lower case) is kept if the share of
documents that have it lies within a band: neither so common that every text
has it nor so rare that a typing error makes one. Lexicons are random subsets
of the band, nested by density: each of ``subsets`` hash functions gives a term
a number of leading zero bits, and subset j of density 2^-l has the terms with
l of them or more. A text with n terms of the band is fingerprinted in the
densities that leave it about one term a subset, and about half of one, so that short
and long texts alike keep some subsets untouched by an edit; the sorted
distinct terms of each subset are hashed. Likeness is the share of equal hashes
among the subsets that are not empty for both.

Document frequencies cover all rows. Terms of the band number at most (mean
distinct terms of a text) / low, whatever the number of documents; they are
broadcast if they are counted to be within ``max_broadcast``, and joined by a
shuffle otherwise.

The following document is found without a global sort: quantiles of the id,
each divided evenly, give ordered groups of some hundreds of rows; a group is a
window's partition, and the first row of the next group closes it. Texts are
shuffled once.

Null and empty texts, and texts without a term of the band, are fingerprinted
by a hash of the text itself. Rows with equal ids are ordered by a hash of
their text; null ids come first. With a single row, the next is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of documents a term of the band is in, at least and at most.
LOW, HIGH = 0.001, 0.1
SUBSETS = 16
MAX_BROADCAST = 1 << 20
#: Quantiles of the id, and expected rows of a group.
QUANTILES, GROUP_ROWS = 128, 256
_HEX = 8


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda t: t != "")


def lexicon(texts: DataFrame, low: float, high: float, subsets: int) -> DataFrame:
    """(term, zeros): terms of the band, and the leading zero bits of each of their hashes."""
    every = texts.agg(F.count("*").alias("docs"))
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.where("df > 1").join(F.broadcast(every)).where((F.col("df") >= F.col("docs") * low) & (F.col("df") <= F.greatest(F.col("docs") * high, F.lit(2))))
    zeros = F.array(*(_zeros(F.substring(F.md5(F.concat(F.col("term"), F.lit(f"\x1f{j}")).cast("binary")), 1, 8)) for j in range(subsets)))
    return band.select("term", zeros.alias("zeros"))


def _zeros(hexadecimal: Column) -> Column:
    """Leading zero bits of eight hexadecimal digits."""
    return (F.lit(32) - F.length(F.regexp_replace(F.conv(hexadecimal, 16, 2), "^0+", ""))).cast("byte")


def _level(n: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(n)).cast("int"))


def with_hashes(texts: DataFrame, subsets: int) -> DataFrame:
    """Adds level, and hashes of the subsets in that density and the next; "" where a subset is empty.

    texts: found, an array of (term, zeros). Terms that are in no subset go
    first, and columns that are used often are columns of their own, so that
    they are computed once.
    """
    texts = texts.withColumn("level", _level(F.size("found")))
    texts = texts.withColumn("dense", F.sort_array(F.filter("found", lambda x: F.array_max(x["zeros"]) >= F.col("level"))))

    def joined(j: int, more: int) -> Column:
        return F.array_join(F.transform(F.filter("dense", lambda x: x["zeros"][j] >= F.col("level") + more), lambda x: x["term"]), " ")

    lists = F.array(*(joined(j, more) for more in (0, 1) for j in range(subsets)))
    hashes = F.transform(lists, lambda x: F.when(x == "", x).otherwise(F.substring(F.md5(x.cast("binary")), 1, _HEX)))
    return texts.withColumn("hashes", hashes).drop("found", "dense")


def likeness(level_a: Column, a: Column, level_b: Column, b: Column, raw_a: Column, raw_b: Column, subsets: int) -> Column:
    """Share of equal hashes among the subsets that one of the texts has terms in, in the densities both have."""

    def share(x: Column, y: Column) -> Column:
        pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != "") | (p["y"] != ""))
        equal = F.filter(pairs, lambda p: p["x"] == p["y"])
        return F.when(F.size(pairs) > 0, F.size(equal) / F.size(pairs)).otherwise(F.lit(0.0))

    first, second = lambda x: F.slice(x, 1, subsets), lambda x: F.slice(x, subsets + 1, subsets)
    by_hash = (
        F.when(level_a == level_b, share(a, b))
        .when(level_a == level_b + 1, share(first(a), second(b)))
        .when(level_b == level_a + 1, share(second(a), first(b)))
        .otherwise(F.lit(0.0))
    )
    return F.when(raw_a.isNotNull() | raw_b.isNotNull(), F.coalesce((raw_a == raw_b).cast("double"), F.lit(0.0))).otherwise(by_hash)


def grouped(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds quantile and slot: slots are numbered along the id, within quantiles of it."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    count, bounds = docs.agg(F.count("*"), F.percentile_approx("doc_id", at, 10_000)).first()
    bounds = sorted(set(bounds or []))
    if not bounds:
        return docs.withColumn("quantile", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    m = max(1, -(-count // (QUANTILES * group_rows)))
    ends = F.array(*(F.lit(b).cast("long") for b in bounds))
    quantile = F.coalesce(F.size(F.filter(ends, lambda b: b <= F.col("doc_id"))), F.lit(0))
    low, high = F.get(ends, F.col("quantile") - 1).cast("double"), F.get(ends, F.col("quantile")).cast("double")
    part = F.floor((F.col("doc_id").cast("double") - low) / (high - low) * m).cast("long")
    slot = F.col("quantile") * m + F.least(F.lit(m - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.coalesce(part, F.lit(0).cast("long"))))
    return docs.withColumn("quantile", quantile).withColumn("slot", slot)


def _followers(firsts: DataFrame) -> DataFrame:
    """(slot, opening): which slot each first row closes; the very first closes the last slot.

    firsts: quantile, slot, opening. Slots meet by quantile only, and quantiles are few.
    """
    along = Window.partitionBy("quantile").orderBy("slot")
    inside = firsts.withColumn("closes", F.lag("slot").over(along))
    ends = firsts.groupBy("quantile").agg(F.max("slot").alias("last"))
    around = Window.orderBy("quantile")
    whole = Window.partitionBy()
    ends = ends.select("quantile", F.coalesce(F.lag("last").over(around), F.max(F.struct("quantile", "last")).over(whole)["last"]).alias("before"))
    return inside.join(F.broadcast(ends), "quantile").select(F.coalesce("closes", "before").alias("slot"), "opening")  # a row a quantile


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS, max_broadcast: int = MAX_BROADCAST, group_rows: int = GROUP_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    known = lexicon(slim, low, high, subsets)
    known = known.unionByName(slim.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(None).cast("array<tinyint>").alias("zeros"))).persist()
    if known.count() <= max_broadcast:
        known = F.broadcast(known)

    order = Window.partitionBy("slot").orderBy("doc_id", F.xxhash64("text"))
    rows = grouped(slim, group_rows).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    opening = _followers(rows.where("place = 1").select("quantile", "slot", F.col("text").alias("opening")))
    rows = rows.join(opening, "slot").withColumn("closing", F.col("next").isNull()).withColumn("next", F.coalesce("next", "opening"))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(next, 1, cut)"))
    rows = rows.withColumn("n_chars", n).withColumn("cut", k).withColumn("edited", edited)
    nothing = F.lit(None).cast("string")
    units = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")),
        F.struct(F.lit(2).alias("which"), F.when(F.col("closing"), F.col("next")).otherwise(nothing).alias("text")),
    )
    rows = rows.select("slot", "place", "doc_id", F.col("n_chars").cast("long"), F.explode(F.filter(units, lambda u: u["text"].isNotNull())).alias("unit"))
    rows = rows.select("slot", "place", "doc_id", "n_chars", "unit.which", "unit.text")
    # what isn't a term rides on an empty one, so that the other rows are small
    sha256 = F.when(F.col("which") == 1, F.sha2(F.col("text").cast("binary"), 256))
    about = F.struct("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("md5"), sha256.alias("sha256"))
    listed = F.concat(F.array(F.struct(F.lit("").alias("term"), about.alias("about"))), F.transform(terms(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(None).alias("about"))))
    each = rows.select("slot", "place", "which", F.explode(listed).alias("x")).select("slot", "place", "which", "x.term", "x.about").join(known, "term")
    found = each.groupBy("slot", "place", "which").agg(F.collect_list(F.when(F.col("term") != "", F.struct("term", "zeros"))).alias("found"), F.first("about", True).alias("about"))
    hashed = with_hashes(found.withColumn("raw", F.when(F.size("found") == 0, F.col("about.md5"))), subsets)
    text = F.coalesce(F.concat(F.lit("raw:"), "raw"), F.concat_ws(":", F.col("level").cast("string"), F.array_join("hashes", ",")))
    hashed = hashed.withColumn("print", F.struct("level", "hashes", "raw", text.alias("text")))
    pick = lambda w, c: F.first(F.when(F.col("which") == w, F.col(c)), True)
    wide = hashed.groupBy("slot", "place").agg(pick(0, "print").alias("own"), pick(1, "print").alias("edited"), pick(2, "print").alias("closing"), pick(0, "about").alias("about"), pick(1, "about").alias("edited_about"))
    following = F.coalesce("closing", F.lead("own").over(Window.partitionBy("slot").orderBy("place")))
    wide = wide.withColumn("next", following)
    near = lambda a, b: likeness(a["level"], a["hashes"], b["level"], b["hashes"], a["raw"], b["raw"], subsets)
    own, edit, after = F.col("own"), F.col("edited"), F.col("next")
    return wide.select(
        "about.doc_id",
        "about.n_chars",
        F.col("edited_about.sha256").alias("edited_sha256"),
        own["text"].alias("fingerprint"),
        edit["text"].alias("edited_fingerprint"),
        near(own, edit).alias("near_edited"),
        near(own, after).alias("near_next"),
    )
