"""Line deduplication over levelled sorted runs of line hashes.

`LineRuns` keeps the corpus's line index as runs, as a log-structured merge tree
does: tables of (line hash, documents holding it, largest doc_id holding it),
dealt into buckets by hash and sorted within them. Each batch of documents is
put against the runs by a merge anti-join, which tells the lines that no run
knows, and then adds a run of its own at level 0; `fanout` runs of a level are
merged into one run of the next. Buckets meet their like, so neither probing
nor compaction moves a run, and no batch rereads the documents of another.

`judged` feeds a whole table in batches of descending ids. So the largest
document that holds a line is in the first batch that knows it, and a line that
is new to the runs and single in its batch can be let go of: only lines that
came before, or several times at once, are kept as suspects until the finished
runs tell how many documents hold them.

Defined cases: a null or empty text is one empty line; a null doc_id counts as
the smallest id; rows that share a doc_id are one document in counts, and each
is returned; lines shorter than `least_chars` always stay; an empty table gives
an empty result; further columns pass through `deduped`.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.llm.common import LOWER, drop_stored, numbered, scratch_root, sliced, stored, texts

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Batches that a whole table is fed in.
BATCHES = 4
FANOUT = 3
#: Places that the holders of one line are dealt to in a join.
SPREAD = 16
SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """128-bit hash of the line's key, or None if the key is too short to be judged. line: already in lower case."""
    key = line.strip(SPACES)
    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def hashed_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, hash): the distinct keys of each document row; texts stay where they are."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, hashes = [], []
                for doc, text in zip(part.column("doc").to_pylist(), texts(part.column("text"))):
                    found = {k for line in text.translate(LOWER).split(b"\n") if (k := line_key(line, least_chars))}
                    ids += [doc] * len(found)
                    hashes += sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc", "hash"])

    return docs.select(hashed_id().alias("doc"), "text").mapInArrow(run, "doc bigint, hash binary")


class LineRuns:
    """Sorted runs of line hashes in levels, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def feed(self, lines: DataFrame) -> tuple[DataFrame, str]:
        """Adds a batch's (doc, hash) rows as a run and returns its suspects, written, and their path: the rows whose
        hash the runs knew before, or other documents of the batch hold too. A document belongs to one batch."""
        own = lines.distinct().groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
        name = self._written(own)
        run = self.spark.table(name)
        new = self.unseen(run.filter("n_docs = 1"))
        known = run.hint("merge").join(new.select("hash").hint("merge"), "hash", "left_anti")
        suspects = stored(holders(lines, known.select("hash")).select("doc", "hash"), "suspects")
        self._put(0, name)
        return suspects

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows whose hash is in no run: a merge anti-join with each run in turn."""
        for level in self.levels:
            for name in level:
                lines = lines.hint("merge").join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_anti")
        return lines

    def index(self) -> DataFrame | None:
        """One row per hash over all runs."""
        names = [name for level in self.levels for name in level]
        return self._merged(names) if names else None

    def drop(self) -> None:
        for level in self.levels:
            self._dropped(level)
        self.levels = []

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._written(self._merged(full)))
            self._dropped(full)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by their order: buckets meet their like without a shuffle."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            run = self.spark.table(name).select("hash", F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
            both = out.hint("merge").join(run.hint("merge"), "hash", "full_outer")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            out = both.select("hash", n_docs.alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))
        return out

    def _written(self, run: DataFrame) -> str:
        name = f"loamix_line_run_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, "hash").sortBy("hash").option("compression", "zstd").saveAsTable(name, format="parquet", path=path)
        return name

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_stored(self.spark, f"{scratch_root(self.spark)}/{name}")


def holders(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows (doc, hash) of lines joined with the row of their hash, if there is one.

    hashes has one row per hash of a line that several documents hold; each goes
    to SPREAD places, so the holders of a line that very many have are dealt out.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("place")
    place = F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("int").alias("place")
    return lines.select("doc", "hash", place).join(hashes.select("*", spread), ["hash", "place"])


def descending(docs: DataFrame, batches: int) -> Column:
    """The batch of a row (doc): about equal ranges of ids, the largest first."""
    shares = F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)])
    found = docs.agg(F.percentile_approx("doc", shares, F.lit(10_000))).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for bound in sorted(set(found or ())):
        batch = batch + (F.col("doc") <= F.lit(bound)).cast("int")
    return batch


def condemned(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """(doc, hashes): for each document with lines to lose, their hashes.

    A hash held by many documents is counted by partial sums.
    """
    spark = docs.sparkSession
    batch = descending(docs.select(hashed_id().alias("doc")), batches).cast("int").alias("batch")
    lines, lines_path = stored(line_hashes(docs, least_chars).select("doc", "hash", batch), "line-hashes", ["batch"])
    runs = LineRuns(spark, fanout)
    suspects, paths = None, []
    for k in range(batches):
        found, path = runs.feed(lines.filter(F.col("batch") == k).select("doc", "hash"))
        paths.append(path)
        suspects = found if suspects is None else suspects.unionByName(found)
    index, index_path = stored(runs.index().filter(F.col("n_docs") >= least_docs), "line-index")
    runs.drop()
    lost = holders(suspects, index.select("hash", "max_doc")).filter(F.col("doc") != F.col("max_doc")).select("doc", "hash")
    out, _ = stored(lost.groupBy("doc").agg(F.collect_set("hash").alias("lost_hashes")), "lost-lines")
    for path in (lines_path, index_path, *paths):
        drop_stored(spark, path)
    return out


def judged(
    docs: DataFrame,
    columns: list[str],
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """`columns` of docs (doc_id, text, ...) with kept_text (null where the text is), n_lines and n_dropped."""
    lost = condemned(docs.select("doc_id", "text"), least_chars, least_docs, batches, fanout)
    whole = docs.select(*columns, F.struct(F.col("text"), hashed_id().alias("doc")).alias("judged_row"))
    lost = lost.withColumnRenamed("doc", "lost_doc")
    # one way at every size: what small tables would save by a broadcast, large ones could not
    joined = whole.join(lost.hint("merge"), F.col("judged_row.doc") == F.col("lost_doc"), "left").drop("lost_doc")
    joined = joined.select(*columns, F.col("judged_row.text").alias("judged_text"), "lost_hashes")
    kept_schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)

    def run(batches):
        for whole_batch in batches:
            for batch in sliced(whole_batch, "judged_text"):
                column = batch.column("judged_text")
                out, n_lines, n_dropped = [], [], []
                for text, hashes in zip(texts(column), batch.column("lost_hashes").to_pylist()):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if hashes:
                        bad = set(hashes)
                        left = [x for x in lines if line_key(x.translate(LOWER), least_chars) not in bad]
                        n_dropped.append(len(lines) - len(left))
                        text = b"\n".join(left)
                    else:
                        n_dropped.append(0)
                    out.append(text)
                kept = pa.array(out, pa.binary(), mask=column.is_null().to_numpy(zero_copy_only=False)).cast(pa.string())
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, kept, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    [*columns, "kept_text", "n_lines", "n_dropped"],
                )

    return joined.mapInArrow(run, f"{kept_schema}kept_text string, n_lines bigint, n_dropped bigint")


def digest(docs: DataFrame, **options) -> DataFrame:
    out = judged(docs, ["doc_id"], **options)
    kept = F.coalesce("kept_text", F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def deduped(docs: DataFrame, **options) -> DataFrame:
    """docs with the text that is left; n_chars counted anew where lines went; a text left without any line goes."""
    inner, names = numbered(docs)
    name_of = dict(zip(docs.columns, names))
    whole = inner.withColumnRenamed(name_of["text"], "text").withColumn("doc_id", F.col(name_of["doc_id"]))
    out = judged(whole, [c for c in names if c != name_of["text"]], **options)
    out = out.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    columns = {c: F.col(x) for c, x in name_of.items()} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        counted = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, counted).otherwise(columns["n_chars"])
    return out.select(*[column.alias(c) for c, column in columns.items()])
