"""Document fingerprints from closed syncmers, matched by position, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.indexing import dense_index
from rowloom.session import materialize

# A k-mer is SIZE words; its inner substrings are single words.
SIZE = 4
WORD = r"[^\x20\x09-\x0D]+"
# An anchor is packed into 32 bits: its gap to the anchor before (GAP bits, below the sign) and HASH bits of its hash.
HASH, GAP = 28, 3


def word_hashes(text: Column) -> Column:
    """The hash of each word, in order."""
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def syncmers(hashes: Column, size: int = SIZE) -> Column:
    """(at, hash) of each closed syncmer: a k-mer whose least word hash stands at either edge.

    Whether a k-mer is chosen depends on its own words only, so equal passages choose equal anchors
    wherever they stand. A text of fewer words is one k-mer as a whole; none without words. ``hashes``
    must be a plain column: it is read for every k-mer.
    """
    n = F.size(hashes)
    reach = F.least(n, F.lit(size))

    def word(at: Column, k: int) -> Column:
        return F.get(hashes, at + k)

    inner = range(1, size - 1)

    def closed(at: Column) -> Column:
        edge = F.least(word(at, 0), word(at, size - 1))
        return (n < size) | (edge <= F.least(*[word(at, k) for k in inner]))

    chosen = F.filter(F.sequence(F.lit(0), n - reach), closed)
    anchors = F.transform(chosen, lambda at: F.struct(at.alias("at"), F.xxhash64(*[word(at, k) for k in range(size)]).alias("hash")))
    return F.when(n > 0, anchors).otherwise(F.slice(anchors, 1, 0))


def packed(anchors: Column) -> Column:
    """All anchors in order, each with its gap to the one before. ``anchors`` must be a plain column.

    Neighbouring anchors stand less than SIZE words apart, since of SIZE neighbouring k-mers one is closed; so
    the gaps tell every place.
    """
    most = (1 << GAP) - 1

    def one(anchor: Column, i: Column) -> Column:
        gap = F.least(anchor["at"] - F.coalesce(F.get(anchors, i - 1)["at"], F.lit(0)), F.lit(most))
        return F.shiftleft(gap, HASH).bitwiseOR(F.shiftrightunsigned(anchor["hash"], 64 - HASH).cast("int"))

    return F.transform(anchors, one)


def digits(codes: Column) -> Column:
    """Packed anchors as a string of eight hexadecimal digits each."""
    return F.concat_ws("", F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")))


def merged(a: Column, b: Column) -> Column:
    """The anchors of both texts in order of hash, then of their number in the text; the last bit tells the side."""

    def side(codes: Column, bit: int) -> Column:
        return F.transform(
            codes, lambda c, i: F.shiftleft(c.bitwiseAND(F.lit((1 << HASH) - 1)).cast("bigint"), 33).bitwiseOR(F.shiftleft(i.cast("bigint"), 1)).bitwiseOR(F.lit(bit))
        )

    return F.sort_array(F.concat(side(a, 0), side(b, 1)))


def offsets(both: Column) -> Column:
    """How far equal anchors of the two sides stand apart, in ascending order. ``both`` must be a plain column.

    An anchor that occurs several times is paired with its neighbours in order of number: pairs at one offset
    never share an anchor.
    """
    number = F.lit((1 << 32) - 1)
    at = lambda x: F.shiftright(x, 1).bitwiseAND(number)
    sign = lambda x: F.lit(1) - 2 * x.bitwiseAND(F.lit(1))
    pair = F.filter(
        F.sequence(F.lit(0), F.size(both) - 2),
        lambda i: (F.shiftright(F.get(both, i), 33) == F.shiftright(F.get(both, i + 1), 33))
        & (F.get(both, i).bitwiseXOR(F.get(both, i + 1)).bitwiseAND(F.lit(1)) == 1),
    )
    apart = F.transform(pair, lambda i: (at(F.get(both, i + 1)) - at(F.get(both, i))) * sign(F.get(both, i)))
    return F.when(F.size(both) > 1, F.sort_array(apart)).otherwise(F.array().cast("array<bigint>"))


def longest_run(values: Column) -> Column:
    """How often the most frequent of ascending values occurs."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, value: Column) -> Column:
        run = F.when(state["last"] == value, state["run"] + 1).otherwise(1)
        return F.struct(value.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda state: state["best"])


def likeness(a: str, b: str, chain: Column) -> Column:
    """The share of anchors that match at one common offset, of those of the longer side; two empty texts are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(chain / most)


def with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the packed anchors of column ``text``. Hashes and anchors are columns of their own for one evaluation."""
    hashed = rows.withColumn("_hashes", word_hashes(F.col(text)))
    return hashed.withColumn("_anchors", syncmers(F.col("_hashes"))).withColumn(name, packed(F.col("_anchors"))).drop("_hashes", "_anchors")


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the likeness of two columns of packed anchors."""
    both = rows.withColumn("_both", merged(F.col(a), F.col(b)))
    return both.withColumn("_apart", offsets(F.col("_both"))).withColumn(name, likeness(a, b, longest_run(F.col("_apart")))).drop("_both", "_apart")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every distinct (doc_id, text) with its fingerprint, that of its edited text, and both likenesses.

    A fingerprint holds all anchors of the text in order, so it grows with the text. Likeness is positional: of
    all offsets between equal anchors the one that most share decides.

    Documents stand in order of id, null last, ties by a digest of the text; rows that repeat id and text
    are one document here and get one row each in the result. The edited text ends in the head of the
    next document's (the last one's next is the first). Null texts count as empty. Only documents and the
    heads asked of them are shuffled; the order itself is found on narrow rows.
    """
    text = F.coalesce("text", F.lit(""))
    # Ids of any type: the order of their own type, and a key that is never null.
    plain = docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        F.xxhash64(text).alias("digest"), text.alias("text"),
    )
    keys = ["no_id", "key", "digest"]
    narrow = plain.groupBy(*keys).agg(F.first("id").alias("id"), F.count("*").alias("times"), F.first(F.length("text")).alias("n_chars"))
    placed = dense_index(narrow, ["no_id", "id", "key", "digest"], "_at", derived=True)
    order = materialize(placed.df)
    following = order.select(
        F.pmod(F.col("_at") + 1, F.lit(max(placed.count, 1))).alias("_at"), *[F.col(k).alias(f"to_{k}") for k in keys],
        F.floor(F.col("n_chars") / 4).cast("int").alias("asked"),
    )
    asked = order.join(following, "_at").drop("_at")
    # Both readers below need the same columns of the texts, so they share one shuffle.
    known = with_anchors(plain.select(*keys, "text").join(asked, keys), "text", "own")
    heads = known.select(
        *[F.col(f"to_{k}").alias(k) for k in keys], F.substr("text", F.lit(1), F.col("asked")).alias("head"), F.col("own").alias("next"),
    ).dropDuplicates(keys)
    edited = known.join(heads, keys).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head"))
    )
    done = with_anchors(edited, "edited", "changed")
    done = with_likeness(with_likeness(done, "own", "changed", "near_edited"), "own", "next", "near_next")
    return done.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("own")).alias("fingerprint"), digits(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
