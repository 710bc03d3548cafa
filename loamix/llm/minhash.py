"""Near-duplicate groups by MinHash: universal hash minima, banding, verification, star components.

Texts with equal shingle sets are one class from the start. Each class sends
its bands to buckets. In a bucket, members are compared with its least member
only, never all with all; a pair passes if the share of equal minima allows it
and then its full shingle sets meet the threshold. Passing pairs join
components, and pairs inside a component need no comparison. Classes whose
buckets still hold several components are joined exactly, by the prefixes of
their sets (see `linked_exactly`). So no link between classes that share a
bucket is lost, and no bucket is compared all with all.

Defined cases: a text without words (null, empty, white space) has an empty
set and is linked with nothing; a null doc_id is linked with nothing and kept;
rows that share a doc_id share its component; an empty table gives an empty
result; further columns pass through `deduped`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.llm.common import Shared, drop_stored, numbered, stored, utf8
from loamix.llm.components import stars
from loamix.llm.shingles import mix, shingle_sets

#: Bands of rows: at a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8**4)**28, 4e-7.
BANDS, ROWS = 28, 4
THRESHOLD = 80
SHINGLE = 5
#: Share of equal minima below which a pair isn't compared in full: five deviations under the threshold.
LEAST_EQUAL = 0.8 - 5 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
#: Heads that a group takes in the first of the later rounds, at most, and by how much that grows each round.
FIRST_HEADS, MORE_HEADS = 16, 8
#: Prefix shingles of heads that are sent to the members at a time (40 bytes each), and matches that a task works on together.
HEAD_KEYS, MATCHES = 500_000, 2_000_000
#: Places of the rough count of shingles: 8 MB, whatever the input.
PLACES = 1 << 20

#: Shingles of recent heads that a task keeps.
KEPT = 4_000_000

_RNG = np.random.default_rng(97)
FACTOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFT = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each universal (multiply-add-shift) hash over the set, 32 bits each."""
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024]
        values = FACTOR[:, None] * part[None, :]
        values += SHIFT[:, None]
        np.minimum(best, values.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys of (n, BANDS * ROWS) signatures."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return keys.view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), d1 and d2 (128 bits that name the set) and its signature."""

    def run(batches):
        for batch in batches:
            n, d1, d2, signs = [], [], [], []
            for s in shingle_sets(*utf8(batch.column("text")), k):
                n.append(len(s))
                d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                d2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signs, pa.binary())],
                ["doc_id", "n", "d1", "d2", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, rep): a row per class and band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                signs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32)
                keys = band_keys(signs.reshape(batch.num_rows, -1))
                reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps, pa.int64())], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key bigint, rep bigint")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with enough equal minima and sizes near enough, checked on the signatures."""
    of = lambda side: classes.select(F.col("rep").alias(side), F.struct("n", "sig").alias(f"s{side}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for side in ("sa", "sb"):
                column = batch.column(side)
                signs = np.frombuffer(b"".join(column.field("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                sides.append((signs, column.field("n").to_numpy(zero_copy_only=False)))
            (x, nx), (y, ny) = sides
            close = 100 * np.minimum(nx, ny) >= THRESHOLD * np.maximum(nx, ny)
            keep = pa.array(close & ((x == y).mean(axis=1) >= LEAST_EQUAL))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def pair_texts(wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, str]:
    """(id, text) of the wanted ids, written once, and its path."""
    return stored(docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi"), "pair-texts")


def confirmed(pairs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet the threshold; the sets of recent heads are kept, up to a size."""
    of = lambda side: found.select(F.col("id").alias(side), F.col("text").alias(f"t{side}"))

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            heads = batch.column("a").to_pylist()
            head_texts, keep = batch.column("ta"), []
            for i, s in enumerate(shingle_sets(*utf8(batch.column("tb")), k)):
                left = kept.get(heads[i])
                if left is None:
                    if sum(map(len, kept.values())) > KEPT:
                        kept.clear()
                    left = kept[heads[i]] = next(shingle_sets(*utf8(head_texts.slice(i, 1)), k))
                shared = len(np.intersect1d(left, s, assume_unique=True))
                keep.append(100 * shared >= THRESHOLD * (len(left) + len(s) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def grouped(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the shingle set) and component: the least doc_id reachable over links, itself included."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    signs, signs_path = stored(signed(docs, k), "signatures")
    filled = signs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes, classes_path = stored(
        filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes"
    )
    buckets, buckets_path = stored(banded(classes), "buckets")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("top")).filter("head <> top")
    members, members_path = stored(buckets.join(shared.select("key", "head"), "key").distinct(), "members")
    drop_stored(spark, buckets_path)

    # first round: every member of a bucket with the bucket's least
    pairs = members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    passed, passed_path = stored(likely(pairs, classes), "likely")
    found, found_path = pair_texts(passed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts)
    star, star_path = stars(confirmed(passed, found, k).unionByName(same_id(signs, classes)))
    drop_stored(spark, passed_path)
    drop_stored(spark, found_path)

    # what round one left apart, though it shares a bucket
    placed = with_components(members.select("key", "rep"), star)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    apart, apart_path = stored(placed.join(mixed, "key").select("rep").distinct(), "apart")
    drop_stored(spark, members_path)
    if not apart.isEmpty():
        star, star_path = linked_exactly(apart, classes, texts, star, star_path, k)

    reps = classes.select("n", "d1", "d2", "rep").join(star.select(F.col("a").alias("rep"), F.col("b").alias("c")), "rep", "left")
    reps = reps.select("n", "d1", "d2", F.coalesce("c", "rep").alias("component"))
    joined = signs.select("doc_id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    out, _ = stored(joined.select("doc_id", "n", component.alias("component")), "components")
    for path in (signs_path, classes_path, apart_path, star_path):
        drop_stored(spark, path)
    return out


def with_components(rows: DataFrame, star: DataFrame) -> DataFrame:
    """rows with the component `comp` of their rep."""
    home = star.select(F.col("a").alias("rep"), F.col("b").alias("c"))
    return rows.join(home, "rep", "left").withColumn("comp", F.coalesce("c", "rep")).drop("c")


def frequencies(found: DataFrame, k: int) -> np.ndarray:
    """How many of the texts hold each shingle, by a hash of PLACES values: a rough order of rare to frequent."""

    def run(batches):
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for s in shingle_sets(*utf8(batch.column("text")), k):
                np.add.at(counts, s & np.uint64(PLACES - 1), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], ["place", "n"])

    out = np.zeros(PLACES, np.int64)
    table = found.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[table["place"].to_numpy()] = table["n"].to_numpy()
    return out


def prefixes(found: DataFrame, counts: np.ndarray, k: int) -> DataFrame:
    """(key, rep, n, pos): of each set the rarest shingles, of which a partner must share one, with their place in the order."""
    shared = Shared(found.sparkSession, counts)

    def run(batches):
        known = shared.get()
        for batch in batches:
            keys, reps, sizes, places = [], [], [], []
            for rep, s in zip(batch.column("id").to_pylist(), shingle_sets(*utf8(batch.column("text")), k)):
                n = len(s)
                most = n - -(-THRESHOLD * n // 100) + 1
                order = np.lexsort((s, known[s & np.uint64(PLACES - 1)]))[:most]
                keys.append(s[order].view(np.int64))
                reps.append(np.full(len(order), rep, np.int64))
                sizes.append(np.full(len(order), n, np.int64))
                places.append(np.arange(len(order)))
            if keys:
                arrays = [pa.array(np.concatenate(x)) for x in (keys, reps, sizes, places)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "rep", "n", "pos"])

    return found.mapInArrow(run, "key bigint, rep bigint, n bigint, pos bigint")


def near_heads(left: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of a head and a member of another component that may meet the threshold, each once.

    Heads go to the members in blocks of at most HEAD_KEYS prefix shingles, so
    members stay where they are, however many share a shingle. All shingles that
    two prefixes share are counted together: at the last of them, at places i
    and j, the sets can't share more than those and min(x - i, y - j) - 1 others.
    """
    spark = left.sparkSession
    own = left.join(heads, "rep", "left_semi").select("rep", "n", "comp", "key", "pos")
    blocks = max(1, -(-own.count() // HEAD_KEYS))
    members = left.groupBy("rep", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("p"))  # a prefix each
    members = members.select("rep", "n", "comp", F.col("p.key").alias("keys"), F.col("p.pos").alias("places"))
    out = None
    for block in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == block).toArrow()
        order = np.argsort(part["key"].to_numpy(), kind="stable")
        shared = Shared(spark, {c: part[c].to_numpy()[order] for c in ("key", "rep", "n", "comp", "pos")})

        def run(batches, shared=shared):
            h = shared.get()
            for batch in batches:
                keys, places = batch.column("keys"), batch.column("places")
                sizes = keys.value_lengths().to_numpy()
                flat, at = keys.flatten().to_numpy(), places.flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)
                lo, hi = np.searchsorted(h["key"], flat, "left"), np.searchsorted(h["key"], flat, "right")
                ends = np.cumsum(hi - lo)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                i = 0
                while i < batch.num_rows:  # members whose matches fit into memory together; a member alone has at most HEAD_KEYS
                    base = ends[starts[i] - 1] if starts[i] else 0
                    j = i + 1
                    while j < batch.num_rows and (ends[starts[j + 1] - 1] if starts[j + 1] else 0) - base <= MATCHES:
                        j += 1
                    a, b = starts[i], starts[j]
                    times = (hi - lo)[a:b]
                    total = int(times.sum())
                    if total:
                        spot = np.repeat(np.arange(a, b), times)
                        match = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + lo[spot]
                        yield candidates(batch, h, row[spot], match, at[spot])
                    i = j

        found = members.mapInArrow(run, "a bigint, b bigint")
        out = found if out is None else out.unionByName(found)
    return out


def candidates(batch: pa.RecordBatch, heads: dict, row: np.ndarray, match: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Pairs of the matched prefix shingles (member's row and place, head's entry) that may meet the threshold."""
    rep, n, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "comp"))
    apart = heads["comp"][match] != comp[row]
    row, match, place = row[apart], match[apart], place[apart]
    order = np.lexsort((heads["rep"][match], row))
    row, match, place = row[order], match[order], place[order]
    head = heads["rep"][match]
    if not len(row):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (head[1:] != head[:-1])]))
    shared = np.diff(np.concatenate([first, [len(row)]]))
    x, y = n[row[first]], heads["n"][match[first]]
    i, j = np.maximum.reduceat(place, first), np.maximum.reduceat(heads["pos"][match], first)
    need = -(-THRESHOLD * (x + y) // (100 + THRESHOLD))
    keep = shared + np.minimum(x - i, y - j) - 1 >= need
    return pa.RecordBatch.from_arrays([pa.array(head[first][keep]), pa.array(rep[row[first]][keep])], ["a", "b"])


def linked_exactly(apart: DataFrame, classes: DataFrame, texts: DataFrame, star: DataFrame, star_path: str, k: int) -> tuple[DataFrame, str]:
    """Components, and their path, after all links among the classes in `apart`, by prefix and position filtering.

    Sets are put in one order, rare shingles first. Two sets of sizes x and y
    that meet the threshold share o = ceil(t (x + y) / (1 + t)) shingles, one of
    them in both prefixes (see `near_heads`). Documents that share a frequent
    passage and differ elsewhere are never paired. In each shingle's group, heads from
    outside the group's largest component meet all others of another component;
    heads grow in number from round to round until none is left.
    """
    spark = apart.sparkSession
    near_classes, classes_path = stored(classes.join(apart, "rep", "left_semi"), "classes-apart")
    found, found_path = pair_texts(apart.select(F.col("rep").alias("id")), texts)
    members, members_path = stored(prefixes(found, frequencies(found, k), k), "prefixes")
    spent, heads_a_group, heads_paths = None, FIRST_HEADS, []
    while True:
        placed = with_components(members, star)
        mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        left, left_path = stored(placed.join(mixed, "key").select("key", "rep", "n", "pos", "comp"), "mixed")
        drop_stored(spark, members_path)
        members, members_path = left.drop("comp"), left_path
        sizes = left.groupBy("key", "comp").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
        unspent = left.join(largest, "key").filter("comp <> main").select("key", "rep")
        if spent is not None:
            unspent = unspent.join(spent, "rep", "left_anti")
        salt = F.pmod(F.xxhash64("rep"), F.lit(heads_a_group)).alias("salt")
        heads, heads_path = stored(unspent.groupBy("key", salt).agg(F.min("rep").alias("rep")).select("rep").distinct(), "heads")
        heads_paths.append(heads_path)
        if heads.isEmpty():
            for path in (members_path, classes_path, found_path, *heads_paths):
                drop_stored(spark, path)
            return star, star_path
        pairs, pairs_path = stored(near_heads(left, heads), "pairs")
        passed, passed_path = stored(likely(pairs, near_classes), "likely")
        after, after_path = stars(confirmed(passed, found, k).unionByName(star))
        drop_stored(spark, passed_path)
        drop_stored(spark, pairs_path)
        drop_stored(spark, star_path)
        star, star_path = after, after_path
        spent = heads if spent is None else spent.unionByName(heads)
        heads_a_group *= MORE_HEADS


def same_id(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id but not a text."""
    own = signs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n", "d1", "d2")
    several = own.groupBy("doc_id").agg(F.count_distinct("d1", "d2", "n").alias("sets")).filter("sets > 1").select("doc_id")
    rows = own.join(several, "doc_id", "left_semi").join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    return rows.filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def digest(docs: DataFrame, k: int) -> DataFrame:
    out = grouped(docs, k)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def deduped(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs without the documents that are linked to one of a smaller doc_id; one row of those that share a doc_id.

    Of such rows the one of the least text stays, and one with text before one
    without. They are found by counting ids, so texts of other rows don't move.
    """
    linked = F.col("doc_id") != F.col("component")
    ids = grouped(docs.select("doc_id", "text"), k).filter(F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max(linked).alias("gone"), F.count("*").alias("n_rows"))
    found, _ = stored(ids.filter("gone or n_rows > 1").select("doc_id", "gone"), "gone-or-repeated")
    inner, names = numbered(docs)
    of = dict(zip(docs.columns, names))
    found = found.select(F.col("doc_id").alias("id"), "gone")
    same = F.col(of["doc_id"]) == F.col("id")
    out = inner.join(found.select("id"), same, "left_anti")
    repeated = found.filter("not gone").select("id")
    if not repeated.isEmpty():
        plain = [x for c, x in of.items() if c != "text" and not isinstance(docs.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        order = F.struct(F.coalesce(F.trim(of["text"]), F.lit("")) == "", of["text"], *plain)
        rows = inner.join(repeated, same, "left_semi").groupBy(of["doc_id"]).agg(F.min_by(F.struct(*names), order).alias("one"))
        out = out.unionByName(rows.select("one.*"))
    return out.select(*[F.col(x).alias(c) for c, x in of.items()])
