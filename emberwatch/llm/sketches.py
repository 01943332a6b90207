"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash range is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

SHINGLE_WORDS = 5
#: One hash in 2 ** FRACTION_BITS is kept: the kept ones are those that are 0 in so many leading bits.
FRACTION_BITS = 1
#: Of a kept hash so many bits below the threshold's stay.
KEPT_BITS = 32
BLANKS = r"[\x20\x09-\x0D]+"
#: Neighbouring ids per cell when rows are put next to their neighbours.
CELL_IDS = 1024


def word_hashes(text: str) -> Column:
    words = F.split(F.coalesce(F.col(text), F.lit("")), BLANKS)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def kept_hashes(hashes: str, bits: int = FRACTION_BITS) -> Column:
    """The sketch: hashes below the threshold of all runs of SHINGLE_WORDS words, as KEPT_BITS each, sorted, each once.

    A text with fewer words is one shingle. Sketches made at one fraction merge by union, and the share of one in
    another estimates containment however unequal the texts are.
    """
    h = F.col(hashes)
    rest = lambda i: [F.get(h, i + k) for k in range(1, SHINGLE_WORDS)]  # noqa: E731  nulls behind the end are skipped
    shingles = F.transform(h, lambda x, i: F.xxhash64(x, *rest(i)))
    whole = F.slice(shingles, F.lit(1), F.greatest(F.size(h) - (SHINGLE_WORDS - 1), F.lit(1)))
    low = F.filter(whole, lambda s: F.shiftrightunsigned(s, 64 - bits) == 0) if bits else whole
    return F.sort_array(F.array_distinct(F.transform(
        low, lambda s: F.shiftrightunsigned(s, 64 - bits - KEPT_BITS).bitwiseAND((1 << KEPT_BITS) - 1))))


def fingerprint(sketch: str, text: str) -> Column:
    """The sketch in base64, four bytes per hash; a text with none under the threshold is told by '=' and its own hash."""
    hexed = F.array_join(F.transform(sketch, lambda s: F.lpad(F.hex(s), KEPT_BITS // 4, "0")), "")
    alone = F.concat(F.lit("="), F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))
    packed = F.translate(F.base64(F.unhex(hexed)), "\r\n", "")
    return F.when(F.size(sketch) > 0, packed).when(F.coalesce(F.col(text), F.lit("")) == "", F.lit("")).otherwise(alone)


def shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: str, b: str, text_a: str, text_b: str) -> Column:
    """Resemblance of two sketches; where neither has a hash, 1 for equal texts (so equal fingerprints) and else 0."""
    both = shared(a, b)
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, (F.col(text_a) == F.col(text_b)).cast("double")).otherwise(both / union)


def containment(a: str, b: str) -> Column:
    """Share of a's shingles that b has, as their sketches tell; null where a has no hash."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a))


def successors(keys: DataFrame, low: int, high: int) -> DataFrame:
    """(key, up): the next larger of the distinct integers `key`, null for the largest.

    No window holds more than CELL_IDS keys: each works inside a cell of neighbouring numbers, and what follows a
    cell's last key is found among the cells in the same way.
    """
    if high - low < CELL_IDS:
        return keys.withColumn("up", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy("key")))
    cell = F.expr(f"(key - {low}) div {CELL_IDS}")
    celled = checkpointed(keys.withColumn("cell", cell))  # read three times; the levels would multiply
    firsts = celled.groupBy("cell").agg(F.min("key").alias("first"))
    beyond = successors(firsts.select(F.col("cell").alias("key")), 0, (high - low) // CELL_IDS)
    beyond = beyond.join(firsts.withColumnRenamed("cell", "up"), "up").select(F.col("key").alias("cell"), "first")
    inside = F.lead("key").over(Window.partitionBy("cell").orderBy("key"))
    return celled.withColumn("inside", inside).join(beyond, "cell", "left").select(
        "key", F.coalesce("inside", "first").alias("up"))


def with_next(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text, `also` and, as next_text and so on, those of the next row by falling doc_id; after the last: the first.

    Rows without doc_id come last; rows of one doc_id follow each other in order of their text's hash. A row is next to
    its neighbour in its cell of CELL_IDS ids, and a cell's largest id is also sent to the cell above.
    """
    bounds = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = ((v or 0) // CELL_IDS for v in bounds)
    # Ids and cells are divided before anything is subtracted, so that ids at both ends of a long do not overflow.
    cell_of = F.expr(f"doc_id div {CELL_IDS}L - cast(doc_id % {CELL_IDS}L < 0 as int) - {low}L + 1")
    placed = docs.select("doc_id", "text", *also).withColumn("cell", F.coalesce(cell_of, F.lit(0).cast("long")))
    tops = placed.groupBy("cell").agg(F.max("doc_id").alias("top"))
    ups = successors(tops.select(F.col("cell").alias("key")), 0, high - low + 1)
    first_cell = ups.agg(F.min("key").alias("wrap"))
    ghosts = ups.crossJoin(F.broadcast(first_cell)).select(F.col("key").alias("cell"), F.coalesce("up", "wrap").alias("to"))
    # A row per cell, written once: known to be small, it is sent to the texts, which then move once, to their cells.
    ghosts = checkpointed(ghosts.join(tops, "cell"))
    rows = placed.join(ghosts, "cell").withColumn("g", F.explode(F.when(
        F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("cell"), F.lit(0).alias("ghost")),
                                                           F.struct(F.col("to").alias("cell"), F.lit(1).alias("ghost"))))
        .otherwise(F.array(F.struct(F.col("cell"), F.lit(0).alias("ghost"))))))
    # In the last place of its new cell: there, ghosts come after all rows, the greatest first.
    order = Window.partitionBy("g.cell").orderBy("g.ghost", F.desc("doc_id"), F.xxhash64("text"), "text")
    nexts = {f"next_{c}": F.lead(c).over(order) for c in ("text", *also)}
    return rows.withColumns(nexts).filter("g.ghost = 0").select("doc_id", "text", *also, *nexts)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited.

    One row per row of `docs`, only built-in functions. The edited text is the text with its last floor(n_chars / 2)
    code points replaced by the first as many of the next document (see with_next). A null text counts as empty; an
    empty text has the fingerprint ''. Fingerprints hold one hash in 2 ** FRACTION_BITS, and likeness and containment are
    those of the fingerprints alone: estimates, whose error falls with the number of shingles. Repeated rows are
    neighbours of each other; rows of one doc_id, and those without, are ordered in one task. A text of any length is
    one row. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.left("text", F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.left("next_text", half)))
    for text, name in (("text", "hs"), ("next_text", "next_hs"), ("edited", "es")):
        rows = rows.withColumn("h", word_hashes(text)).withColumn(name, kept_hashes("h")).drop("h")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("hs", "text").alias("fingerprint"),
        fingerprint("es", "edited").alias("edited_fingerprint"), likeness("hs", "es", "text", "edited").alias("near_edited"),
        likeness("hs", "next_hs", "text", "next_text").alias("near_next"), containment("hs", "es").alias("contained_edited"))
