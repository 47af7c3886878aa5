"""N-gram Jaccard join with set-relation skipping.

Equal sets are one class. A first shuffle deals shingles, packed eight bytes each, to buckets and counts in how many sets a
shingle occurs; only shingles of two sets or more go back to their sets. Sets are then ordered rare shingles first, and two sets
that are similar enough share a shingle within their prefixes, which form the lists of the index.

Two relations between sets save work. Within a list, blocks of sets whose sizes cannot match, and places from which the overlap
cannot be reached, are skipped. And every set of a list is compared with the list's most central set: sets that link to it are one component
and need no comparison with each other, and for the others the distance to that set bounds the distance between them.
What remains is compared pair by pair, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, written
from cubeloom.llm.graph import components
from cubeloom.llm.tokens import lean, text_chunks

WORDS = 4
PERCENT = 85
#: Shingles of this share of a chunk's sets are dealt by set instead of by shingle; about mean set size / share of them exist.
HOT_SHARE = 0.02
BUCKET_SHINGLES = 1_000_000
LEAST_BUCKETS = 48
SEEN = 200_000
BEFORE = 3
CHUNK_BYTES = 4_000_000
HOT_DF = (1 << 31) - 1
LOW48 = np.uint64((1 << 48) - 1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: A-Z lower-cased, words between ASCII blanks; fewer words are one shingle."""
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and blanks
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for i in range(n):
            s = s * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def class_of(found: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).astype(np.int64))


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """kind, doc_id, n, cid per document, and per chunk of documents the shingles that many of its sets hold (kind 1)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in text_chunks(batch.column(1), CHUNK_BYTES):
                sets = [shingles(t, words) for t in texts.to_pylist()]
                n = len(sets)
                distinct = {class_of(s): s for s in sets if len(s)}
                every, counts = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
                hot = every[counts >= max(8, HOT_SHARE * len(distinct))]
                hot_counts = counts[counts >= max(8, HOT_SHARE * len(distinct))]
                m = len(hot)
                names = batch.column(0).slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), pa.concat_arrays([names, pa.nulls(m, pa.int64())]),
                     pa.array(np.concatenate([[len(s) for s in sets], hot_counts]).astype(np.int64)),
                     pa.array(np.concatenate([[class_of(s) if len(s) else 0 for s in sets], hot.view(np.int64)]).astype(np.int64))],
                    names=["kind", "doc_id", "n", "cid"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(read), "kind int, doc_id long, n long, cid long")


def only_equal(size: int, percent: int) -> bool:
    """Whether no other set, not even one with a single shingle more, is similar enough to a set of this size."""
    return 100 * size < percent * (size + 1)


def shared_shingles(docs: DataFrame, hot: np.ndarray, buckets: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """ref, df, shingle: the shingles that two sets or more hold; df -n marks a set's head row, whose shingle is its class."""
    told = docs.sparkSession.sparkContext.broadcast(hot)  # bounded by mean set size / HOT_SHARE

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = told.value
        part, made = TaskContext.get().partitionId(), 0
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0), CHUNK_BYTES):
                for low in range(0, len(texts), 60_000):  # a set has 16 bits
                    sets, names = [], []
                    for text in texts.slice(low, 60_000).to_pylist():
                        found = shingles(text, words)
                        if only_equal(len(found), percent) or (name := class_of(found)) in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        sets.append(found)
                        names.append(name)
                    if not sets:
                        continue
                    sizes = np.array([len(s) for s in sets])
                    ref = (part << 38) | (made << 16)
                    made += 1
                    everything = np.concatenate(sets)
                    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
                    spot = np.searchsorted(common, everything)
                    is_hot = np.zeros(len(everything), bool) if not len(common) else common[np.minimum(spot, len(common) - 1)] == everything
                    # the low 48 bits name the shingle, the high 16 its set in this chunk
                    packed = (everything & LOW48) | (owner << np.uint64(48))
                    bucket = np.where(is_hot, owner, (everything & LOW48) >> np.uint64(16)) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    packed, is_hot, bucket = packed[order], is_hot[order], bucket[order]
                    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    heads = np.array(names, np.int64)
                    head_at = made % buckets
                    rows = []
                    for b in range(buckets):
                        mine, warm = packed[edges[b] : edges[b + 1]], is_hot[edges[b] : edges[b + 1]]
                        if len(mine) or b == head_at:
                            top = (heads.tobytes(), sizes.astype(np.int64).tobytes()) if b == head_at else (b"", b"")
                            rows.append((b, ref, mine[~warm].tobytes(), mine[warm].tobytes(), *top))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                        names=["bucket", "ref", "rare", "warm", "heads", "sizes"],
                    )

    def count(group: pa.Table) -> pa.Table:
        refs, shingle, df = [], [], []
        own = {name: group.column(name).to_pylist() for name in group.column_names}
        rare = [np.frombuffer(x, np.uint64) for x in own["rare"]]
        values = np.concatenate(rare)
        where = np.repeat(np.array(own["ref"], np.int64), [len(x) for x in rare]) | (values >> np.uint64(48)).astype(np.int64)
        names = values & LOW48
        order = np.argsort(names, kind="stable")
        names, where = names[order], where[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
        lengths = np.diff(np.append(first, len(names)))
        # equal sets of different tasks count one by one: the order stays the same for all, and only what no other set holds is left out
        runs = np.repeat(lengths, lengths)
        keep = runs > 1
        refs.append(where[keep]), shingle.append(names[keep].astype(np.int64)), df.append(runs[keep])
        for ref, warm, heads, sizes in zip(own["ref"], own["warm"], own["heads"], own["sizes"]):
            w = np.frombuffer(warm, np.uint64)
            refs.append(ref | (w >> np.uint64(48)).astype(np.int64)), shingle.append((w & LOW48).astype(np.int64)), df.append(np.full(len(w), HOT_DF))
            h = np.frombuffer(heads, np.int64)
            refs.append(ref | np.arange(len(h))), shingle.append(h), df.append(-np.frombuffer(sizes, np.int64))
        return pa.table([pa.array(np.concatenate(refs), pa.int64()), pa.array(np.concatenate(df), pa.int64()), pa.array(np.concatenate(shingle), pa.int64())],
                        names=["ref", "df", "shingle"])

    dealt = docs.select("text").mapInArrow(lean(deal), "bucket int, ref long, rare binary, warm binary, heads binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(count, "ref long, df long, shingle long")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, inter, union of pairs of sets; shingles that only one set holds cannot be in an intersection."""
    left = sets.select(F.col("ref").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("ref").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", inter.alias("inter"), (F.col("na") + F.col("nb") - inter).alias("union"))


def link_classes(docs: DataFrame, described: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """cid, root: the components of the similar classes; classes without a partner are left out."""
    hot_rows = described.filter("kind = 1").groupBy("cid").agg(F.sum("n").alias("n"))
    total, sets_ = described.filter("kind = 0 AND n > 0").agg(F.sum("n"), F.count("*")).first()
    hot = hot_rows.filter(F.col("n") >= HOT_SHARE / 2 * (sets_ or 0)).select("cid").toPandas()["cid"].to_numpy(np.int64)
    buckets = max(LEAST_BUCKETS, int(total or 0) // BUCKET_SHINGLES)
    rows = written(shared_shingles(docs, np.sort(hot.view(np.uint64)), buckets, words, percent), "shared-shingles")
    heads = rows.filter("df < 0").groupBy(F.col("shingle").alias("cid")).agg(F.min("ref").alias("ref"), F.max(-F.col("df")).alias("n"))
    own = rows.filter("df > 0").join(heads, "ref")
    ordered = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    sets = own.groupBy("ref", "cid", "n").agg(ordered.alias("o"))
    sets = sets.withColumn("alone", F.col("n") - F.size("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    sets = sets.withColumn("lead", (prefix - F.col("alone")).cast("int")).filter("lead > 0")
    sets = written(sets.select("ref", "cid", "n", "alone", "lead", F.transform("o", lambda x: x["shingle"]).alias("shingles")), "prefix-sets")

    leads = F.slice("shingles", F.lit(1), F.col("lead"))
    lists = sets.select("ref", "n", "alone", leads.alias("leads"), F.posexplode(leads).alias("at", "shingle"))
    # the few shingles before this one tell most pairs that an earlier list has made
    before = F.slice("leads", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least(F.col("at"), F.lit(BEFORE)))
    lists = lists.withColumn("before", before).drop("leads")
    central = F.struct((F.col("alone") / F.col("n")).alias("own"), "ref", "n")
    hubs = lists.groupBy("shingle").agg(F.count("*").alias("m"), F.min(central).alias("hub")).filter("m > 1")
    lists = lists.join(hubs.select("shingle", "m", F.col("hub.ref").alias("hub"), F.col("hub.n").alias("hub_n")), "shingle")
    lists = written(lists.withColumn("place", F.col("alone") + F.col("at")).drop("at"), "lists")

    # every set of a list with the list's most central set
    hub_pairs = lists.filter((F.col("ref") != F.col("hub")) & _long_enough(F.col("n"), F.col("hub_n"), percent))
    hub_pairs = hub_pairs.select(F.greatest("ref", "hub").alias("a"), F.least("ref", "hub").alias("b")).distinct()
    tried = written(verified(hub_pairs, sets), "hub-pairs")
    is_link = F.col("inter") * 100 >= F.col("union") * percent
    first = components(tried.filter(is_link).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # what is left: sets of different components in one list
    more = lists.filter("m > 2").join(first.select(F.col("node").alias("ref"), "root"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    apart = tried.select("a", "b", F.col("inter").alias("with_hub"))
    more = more.withColumns({"a": F.greatest("ref", "hub"), "b": F.least("ref", "hub")}).join(apart, ["a", "b"], "left").drop("a", "b")
    more = more.withColumn("with_hub", F.when(F.col("ref") == F.col("hub"), F.col("n")).otherwise(F.col("with_hub")))
    # blocks of sizes: a partner lies in the same block or the next
    block = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    more = more.select("shingle", "ref", "n", "place", "root", "alone", "with_hub", "before", block.alias("block"))
    names = ("ref", "n", "place", "root", "alone", "with_hub", "before")
    x = more.withColumn("block", F.explode(F.array("block", F.col("block") + 1))).select("shingle", "block", *[F.col(c).alias(f"x_{c}") for c in names])
    y = more.select("shingle", "block", *[F.col(c).alias(f"y_{c}") for c in names])
    need = F.col("x_n") * percent + F.col("y_n") * percent
    # shared before this shingle: at most as many as either set has there, without what only it holds
    reach = F.least(F.col("x_place") - F.col("x_alone"), F.col("y_place") - F.col("y_alone")) + 1 + F.least(F.col("x_n") - F.col("x_place") - 1, F.col("y_n") - F.col("y_place") - 1)
    # what only one set holds is in no overlap; the rest is split by what is known of each set and the list's most central set
    outside = [F.col(f"{s}_n") - F.col(f"{s}_with_hub") - F.col(f"{s}_alone") for s in "xy"]  # below 0 for the central set itself
    known = F.col("x_with_hub").isNotNull() & F.col("y_with_hub").isNotNull()
    through = F.when(known, F.least("x_with_hub", "y_with_hub") + F.greatest(F.least(*outside), F.lit(0))).otherwise(F.least("x_n", "y_n"))
    bound = F.least(through, F.col("x_n") - F.col("x_alone"), F.col("y_n") - F.col("y_alone")) * (100 + percent) >= need
    ahead = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_ref") < F.col("y_ref")))
    left = x.join(y, ["shingle", "block"]).filter(
        ahead & (F.col("x_root") != F.col("y_root")) & _long_enough(F.col("x_n"), F.col("y_n"), percent) & (reach * (100 + percent) >= need) & bound
        & ~F.arrays_overlap("x_before", "y_before")  # made in an earlier list: a similar pair passes every bound there as well
    )
    left = left.select(F.greatest("x_ref", "y_ref").alias("a"), F.least("x_ref", "y_ref").alias("b")).distinct()
    left = left.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more_links = verified(left, sets).filter(is_link)
    edges = first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more_links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = components(edges)
    return joined.join(sets.select(F.col("ref").alias("node"), "cid"), "node").select("cid", "root")


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per document row: documents link when 100 * intersection >= percent * union of their shingles.

    component_id is the smallest doc_id reachable (null where all are null). Null, empty and blank texts have no shingles, link
    with nothing and keep their own id; repeated rows are equal sets; other columns are not read; an empty table gives no rows.
    """
    described = written(describe(docs, words), "described")
    roots = link_classes(docs, described, words, percent)
    rows = described.filter("kind = 0")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    placed = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", F.lit(None).cast("long")))
    least = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("_least"))
    placed = placed.join(least, "root", "left").select("cid", F.coalesce("_least", "least").alias("component_id"))
    joined = rows.filter("n > 0").join(placed, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


@query("op4_jaccard")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
