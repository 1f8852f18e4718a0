"""Document fingerprints from closed syncmers.

A text is a sequence of symbols: runs of letters and digits (cut every
``SYMBOL_CHARS``) and runs of other visible characters, in lower case, with
``K - 1`` blanks at both ends. A k-mer of ``K`` symbols is an anchor if the
smallest hash of its inner s-mers of ``S`` symbols is the first or the last
one. That depends on the k-mer alone, so an edit moves no anchor elsewhere.

The fingerprint lists anchors in order, each as distance from the anchor
before and hash. Likeness is positional: two fingerprints share a link if both
have the same two successive anchors at the same distance, and likeness is the
share of common links in the larger fingerprint.

All of it is DataFrame functions. ``near_next`` and the edit need each
document's successor by descending id. Documents are ordered by (id, hash of
the text). A sort of these two alone, without texts, cuts the order into ranges
of about ``RANGE_ROWS`` documents, about ``MAX_RANGES`` at most, whatever the ids'
type and spread, and however many documents share one. The sort is dealt by
sampled bounds into far fewer parts than ranges, each cut by its rows' numbers,
as the driver holds about 300 samples of each part. A range's last document
borrows the first one of the next range, so texts are shuffled once and no task
sorts the whole table.

Defined results: null text counts as empty; texts without symbols have the
fingerprint of blanks and are like each other; a null id comes last; rows of
equal id are ordered by the hash of their text, then by text; a single document
is its own successor; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

K, S = 5, 2
SYMBOL_CHARS = 16
#: Documents of a range, about, as long as there are fewer ranges than MAX_RANGES (so their table stays small to broadcast).
RANGE_ROWS, MAX_RANGES = 500, 50_000
#: Ranges that a part of the sort is cut into, as long as there are fewer parts than MAX_PARTS.
PART_RANGES, MAX_PARTS = 64, 2_000
#: Ranges of a task, about, so that tasks don't grow with the table.
TASK_RANGES = 8
#: A range is found among all by two searches in lists of about so many.
FAN = 224


def with_anchors(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``prefix``fingerprint (string) and ``prefix``links (array<long>)."""
    c = lambda name: F.col(f"{prefix}{name}")
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{SYMBOL_CHARS}}}|[^\s\p{{L}}\p{{M}}\p{{N}}]{{1,{SYMBOL_CHARS}}}"), F.lit(0))
    blanks = F.array(*[F.lit(0).cast("long")] * (K - 1))
    out = df.withColumn(f"{prefix}h", F.concat(blanks, F.transform(words, lambda w: F.xxhash64(w)), blanks))
    out = out.withColumn(f"{prefix}s", F.transform(c("h"), lambda x, i: F.xxhash64(x, F.get(c("h"), i + 1))))
    inner = K - S  # from a k-mer's first s-mer to its last

    def anchor(i: Column) -> Column:
        smers = [F.get(c("s"), i + j) for j in range(inner + 1)]
        return F.least(smers[0], smers[-1]) <= F.least(*smers[1:-1])

    out = out.withColumn(f"{prefix}p", F.filter(F.sequence(F.lit(0), F.size(c("h")) - K), anchor))
    out = out.withColumn(f"{prefix}k", F.transform(c("p"), lambda i: F.hash(*[F.get(c("s"), i + j) for j in range(0, inner + 1)])))
    distance = lambda p, j: p - F.coalesce(F.get(c("p"), j - 1), F.lit(0))
    out = out.withColumn(f"{prefix}links", F.transform(c("p"), lambda p, j: F.xxhash64(F.get(c("k"), j), distance(p, j), F.get(c("k"), j - 1))))
    shown = F.transform(c("p"), lambda p, j: F.concat(F.hex(distance(p, j)), F.lit(":"), F.hex(F.get(c("k"), j).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    out = out.withColumn(f"{prefix}fingerprint", F.array_join(shown, " "))
    return out.drop(*[f"{prefix}{name}" for name in "hspk"])


def likeness(a: Column, b: Column) -> Column:
    """Common links over the distinct links of the larger side; 1 if both have none."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and fingerprint."""
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return with_anchors(rows, "_text", "_").select(F.col("_id").alias(id_col), F.col("_fingerprint").alias("fingerprint"))


def _place() -> Column:
    """What documents are ordered by, downwards; null ids are the smallest."""
    return F.struct("id", "h")


def _range_in(lows: Column, place: Column) -> Column:
    """lows: the last places of successive ranges, downwards. Which of them a place belongs to."""
    return F.size(F.filter(lows, lambda low: low > place))


def ranges(df: DataFrame) -> DataFrame:
    """df: id, h. One row a range: ``range`` from the largest place on, ``low`` (its last place) and ``head`` (its first)."""
    # a place is one row, so that no two ranges share it
    narrow = materialise(df.select("id", "h").distinct(), "successors")
    places = narrow.count()
    each = max(RANGE_ROWS, -(-places // MAX_RANGES))
    parts = max(1, min(MAX_PARTS, -(-places // (each * PART_RANGES))))
    dealt = narrow.select(_place().alias("place")).repartitionByRange(parts, "place").sortWithinPartitions("place")
    number = F.monotonically_increasing_id()  # a part's number, then its row's in 33 bits
    dealt = dealt.withColumn("number", number).select("place", F.shiftright("number", 33).alias("part"), F.floor(F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) / each).alias("slice"))
    cut = dealt.groupBy("part", "slice").agg(F.min("place").alias("low"), F.max("place").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("low").desc())  # of one row a range
    return materialise(cut.select((F.row_number().over(order) - 1).alias("range"), "low", "head"), "ranges")


def with_successor(df: DataFrame) -> DataFrame:
    """df: id, text. Adds h (the text's hash), a range and, marked ``borrowed``, copies of the rows that the range before needs; dealt by range."""
    df = df.withColumn("h", F.xxhash64("text"))
    cut = ranges(df)
    # a range is searched for among the last places of every FAN-th range, in one row, then among those of FAN ranges
    steps = cut.groupBy(F.floor(F.col("range") / FAN).alias("step")).agg(F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
    ends = steps.agg(F.sort_array(F.collect_list(F.element_at("lows", -1)), asc=False).alias("ends"))
    dealt = df.withColumn("place", _place()).join(F.broadcast(ends)).withColumn("step", _range_in(F.col("ends"), F.col("place")).cast("long")).drop("ends")
    dealt = dealt.join(F.broadcast(steps), "step").withColumn("range", F.col("step") * FAN + _range_in(F.col("lows"), F.col("place"))).drop("lows", "step", "place")
    whole = Window.partitionBy(F.lit(0)).orderBy("range")
    first = F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = cut.select("range", F.coalesce(F.lead("head").over(whole), first).alias("head"))
    borrowed = dealt.drop("range").join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head.id")) & (F.col("h") == F.col("head.h"))).drop("head")
    borrowed = borrowed.groupBy("range").agg(F.min(F.struct("id", "text", "h")).alias("row")).select("row.*", "range")  # of equal places, the first
    rows = dealt.withColumn("borrowed", F.lit(False)).unionByName(borrowed.withColumn("borrowed", F.lit(True)))
    tasks = -(-cut.count() // TASK_RANGES)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "range") if tasks > usual else rows.repartition("range")


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text: the last half replaced by the start of the next document."""
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = with_anchors(with_successor(docs), "text", "own_")
    order = Window.partitionBy("range").orderBy("borrowed", F.col("id").desc_nulls_last(), F.col("h").desc(), "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("next_links", F.lead("own_links").over(order)).filter("not borrowed")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next"), F.lit(1), half))
    rows = with_anchors(rows.withColumn("edited", edited), "edited", "edited_")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("own_fingerprint").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("own_links"), F.col("edited_links")).alias("near_edited"), likeness(F.col("own_links"), F.col("next_links")).alias("near_next"),
    )
