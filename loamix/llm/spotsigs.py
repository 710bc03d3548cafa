"""SpotSigs fingerprints, in DataFrame functions alone.

A spot signature is a common word (the anchor) with the chain of the two
content words that follow it, common words between them left out. A text's
fingerprint is its set of signatures, each the first eight hexadecimal digits
of an md5, sorted and joined. Likeness of two fingerprints is their Jaccard
similarity. The start of a text is an anchor too, so a text with any letter or
digit has a signature.

Sets whose sizes differ too much can't be alike; so `near_pairs` compares only
sets of the same or neighbouring size partitions that share one of their rarest
signatures.

Defined cases: a null text is an empty one; a text without letters and digits
has an empty fingerprint, which is like another empty one only if the texts are
equal; a null doc_id comes after all others in descending order; rows that
share a doc_id follow one another in the order of their texts; of a single
document the next is itself; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les et des en un une du dans est que qui par pour au pas sur plus ne se ce il sont avec son aux cette ou mais comme on nous sa leur même elle "
    "el los y las del se una con no su al lo más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué sólo han yo hay"
)
START, END = "^", "~"
#: Rows of documents in one stretch of the order of ids.
STRETCH = 4_000
FAN = 256
NO_ID = -(1 << 63)


def anchor_words() -> list[str]:
    return sorted(set(ANCHORS.split()))


def factored(words: list[str]) -> str:
    """An expression for any of the words that decides letter by letter."""
    if words == [""]:
        return ""
    heads = sorted({w[0] for w in words if w})
    parts = [h + factored([w[1:] for w in words if w[:1] == h]) for h in heads]
    if "" in words:
        return "(?:" + "|".join(parts) + ")?"
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def pattern(possessive: bool = True) -> str:
    """A content word with the common words before it; each common word has its space, so longer words don't match.

    A word follows in any case, so giving back common words is never needed;
    possessive, the expression runs without recursion however many there are.
    """
    return "(?:(?:\\^|" + factored(anchor_words()) + ") )*" + "+" * possessive + "[^ ]+"


def segments(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    framed = F.when(words == "", F.lit(f"{START} {END}")).otherwise(F.concat(F.lit(f"{START} "), words, F.lit(f" {END}")))
    return F.regexp_extract_all(framed, F.lit(pattern()), F.lit(0))


def joined_signatures(parts: Column) -> Column:
    """Sorted distinct signatures of a text's segments, joined. parts: a column, not an expression, as it is used twice."""

    def one(x: Column, y: Column) -> Column:
        word = F.substring_index(x, " ", -1)
        chain = F.concat_ws(" ", F.substring_index(x, " ", -2), F.coalesce(F.substring_index(y, " ", -1), F.lit(END)))
        return F.when((F.instr(x, " ") > 0) & (word != END), F.substring(F.md5(chain.cast("binary")), 1, 8))

    chains = F.zip_with(parts, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), one)
    return F.array_join(F.sort_array(F.array_distinct(F.filter(chains, lambda s: s.isNotNull()))), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a text column's fingerprint; the segments stand in a projection of their own."""
    parts = f"{name}_parts"
    return df.withColumn(parts, segments(F.col(text))).withColumn(name, joined_signatures(F.col(parts))).drop(parts)


def signatures(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(".{8}"), F.lit(0))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Jaccard similarity of two fingerprints; of two empty ones, 1 where the texts are equal."""
    shared = F.size(F.array_intersect(signatures(a), signatures(b))).cast("double")
    return F.when((a == "") & (b == ""), F.when(equal, F.lit(1.0)).otherwise(F.lit(0.0))).when(a == b, F.lit(1.0)).otherwise(
        shared / ((F.length(a) + F.length(b)) / 8 - shared)
    )


def stretch_of(bounds: list[int], key: Column) -> Column:
    """How many bounds are at most key, found in steps of FAN."""
    if not bounds:
        return F.lit(0)

    def below(values: str) -> Column:
        return F.size(F.filter(F.expr(values), lambda b: b <= key))

    def array(values: list[int]) -> str:
        return "array(" + ",".join(f"{v}L" if v > NO_ID else "(-9223372036854775807L - 1L)" for v in values) + ")"

    if len(bounds) <= FAN:
        return below(array(bounds))
    step = math.ceil(len(bounds) / FAN)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = below(array([g[0] for g in groups]))
    nested = F.expr("array(" + ",".join(array(g) for g in groups) + ")")
    group = F.greatest(firsts - 1, F.lit(0))
    return F.when(firsts == 0, F.lit(0)).otherwise(group * step + F.size(F.filter(F.get(nested, group), lambda b: b <= key)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own, next_text, following): each document's fingerprint, and the text and fingerprint of the
    document that follows in descending order of ids; after the last comes the first.

    The order is cut into stretches of about STRETCH rows by quantiles of the
    ids, so one shuffle of the texts puts nearly every document beside its
    next. The head of each stretch is sent to the stretch before it as well.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("k"))
    n = docs.count()
    cuts = min(FAN * FAN, -(-n // STRETCH)) - 1
    bounds: list[int] = []
    if cuts > 0:
        shares = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
        found = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, F.lit(max(10_000, 20 * cuts)))).first()[0]
        bounds = sorted({int(b) for b in found})
    # one row per stretch: at most FAN * FAN
    tops = docs.select(key.alias("k")).withColumn("s", stretch_of(bounds, F.col("k"))).groupBy("s").agg(F.max("k").alias("top")).collect()
    order = sorted((r["s"], r["top"]) for r in tops)
    guests = [(s, top, order[i + 1][0] if i + 1 < len(order) else order[0][0]) for i, (s, top) in enumerate(order)]
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame(guests, "s int, top bigint, also int"))
    placed = rows.withColumn("s", stretch_of(bounds, F.col("k"))).join(heads, "s")
    homes = F.when(
        F.col("k") == F.col("top"),
        F.array(F.struct(F.col("s").alias("s"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("s"), F.lit(1).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("s").alias("s"), F.lit(0).alias("guest"))))
    dealt = placed.select("doc_id", "text", "k", F.explode(homes).alias("h")).select("doc_id", "text", "k", "h.s", "h.guest")
    marked = with_fingerprint(dealt.repartition("s"), "text", "own")
    window = Window.partitionBy("s").orderBy("guest", F.col("k").desc(), "text")
    beside = marked.withColumn("next_text", F.lead("text").over(window)).withColumn("following", F.lead("own").over(window))
    return beside.filter("guest = 0").select("doc_id", "text", "own", "next_text", "following")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    base = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    base = with_fingerprint(base, "edited", "other")
    return base.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """(fingerprint, rep, size, sigs): one row per distinct non-empty fingerprint; rep is its least doc_id."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked = with_fingerprint(rows, "text", "fingerprint").select("doc_id", "fingerprint").filter("fingerprint <> ''")
    grouped = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    return grouped.withColumn("sigs", signatures(F.col("fingerprint")))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of class representatives with at least the threshold; `classes` has the members.

    A set's signatures are ordered from rare to frequent over all classes. Two
    sets that are alike enough share one of the first n - ceil(t n) + 1 of each,
    and their sizes lie in the same or in neighbouring powers of 1 / t.
    """
    base = classes(docs)
    sizes = F.size("sigs")
    part = F.floor(F.log(sizes.cast("double")) / F.lit(-math.log(threshold))).cast("int")
    frequency = base.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    spread = base.select("rep", sizes.alias("n"), part.alias("p"), F.explode("sigs").alias("sig")).join(frequency, "sig")
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    left = prefix.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1)).alias("p"))
    right = prefix.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"), "p")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    pairs = left.join(right, ["sig", "p"]).filter(close).select("a", "b").distinct()
    own = base.select("rep", "fingerprint")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("fingerprint").alias("x")), "a")
    both = both.join(own.select(F.col("rep").alias("b"), F.col("fingerprint").alias("y")), "b")
    return both.select("a", "b", likeness(F.col("x"), F.col("y"), F.lit(False)).alias("likeness")).filter(F.col("likeness") >= threshold)
