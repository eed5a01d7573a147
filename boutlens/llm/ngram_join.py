"""Jaccard similarity join on word n-grams, and the groups it links.

A document's set is its distinct five-word shingles, lower-cased (A-Z); with fewer words, the whole sequence.  Two sets
link if their Jaccard similarity is ``PERCENT`` / 100 or more.  Copies are one set.

* Order: rare first, by a table of counts of fixed size that is summed over all documents; ties by hash.  Any common order is
  right, a better estimate only makes the prefixes rarer.
* Prefix filter: linked sets share a shingle among the first ``n - ceil(t n) + 1`` of both.  One shuffle on these shingles
  finds those of two or more sets.
* Filters on pairs: length; position (inside the join, on the first common shingle); suffix (the shingle space is cut into 64
  ranges, and the counts per range bound the symmetric difference from below).  What is left is verified from the texts, once per pair and round.
* Groups: a popular shingle may have any number of sets, so its pairs are not all made.  In a few rounds, the sets of a shingle meet
  one of them (chosen anew per shingle and round, for at most ``FAN`` sets on average); links merge components.  The last round is exact:
  every set outside a shingle's largest component meets all sets of other components.  Pairs inside a component can't
  change the result, so no link between components is lost.

Components are merged by contraction: every node points to its smallest neighbour, edges are rewritten, until
none is left.  Everything stays distributed; tables between steps are written to the shared folder.

Defined cases: null texts and texts without words have an empty set and link with nothing; rows with a null doc_id link, but never name
a component, which is null where no row has an id; rows are told apart by (doc_id, text); sets are named by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm import words
from boutlens.session import discard, materialize

SHINGLE, PERCENT = 5, 80
COUNTERS, PARTS = 1 << 18, 64
RANGES = 64
ROUNDS, FAN = 3, 256
#: shingles that the counters place above this many times the average are taken for shared without a test
HOT = 8


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    h = words.text_hashes((text or "").encode().lower())  # bytes: only A-Z change
    if len(h) >= SHINGLE:
        g = words.Sequence(h).grams(SHINGLE)
        g.sort()
        return g[np.append(True, g[1:] != g[:-1])]
    return words.Sequence(h).of(np.array([0]), np.array([len(h)])) if len(h) else h


def set_id(g: np.ndarray) -> int:
    return int(words.signed(words.mix(np.array([np.add.reduce(words.mix(g)) + np.uint64(len(g))], np.uint64)))[0])


def slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def describe(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: a row per document (doc_id, tid, n, sid, ranges), and counts of shingles as rows (part, counts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for frame in frames:
            out = []
            for t in frame.text:
                g = shingles(t)
                counts += np.bincount(slot(g), minlength=COUNTERS) if len(g) > COUNTERS // 8 else 0
                if len(g) <= COUNTERS // 8:
                    np.add.at(counts, slot(g), 1)
                ranges = np.bincount((g >> np.uint64(58)).astype(np.int64), minlength=RANGES)
                out.append((len(g), set_id(g) if len(g) else None, ranges.astype(np.int32)))
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "tid": frame.tid.astype("Int32"), "n": pd.array([o[0] for o in out], "Int64"),
                                "sid": pd.array([o[1] for o in out], "Int64"), "ranges": [o[2] for o in out], "part": pd.array([None] * len(out), "Int32"), "counts": None})
        each = COUNTERS // PARTS
        used = [p for p in range(PARTS) if counts[p * each : (p + 1) * each].any()]
        if used:
            none = pd.array([None] * len(used), "Int64")
            yield pd.DataFrame({"doc_id": none, "tid": pd.array([None] * len(used), "Int32"), "n": none, "sid": none, "ranges": None,
                                "part": pd.array(used, "Int32"), "counts": [counts[p * each : (p + 1) * each].tobytes() for p in used]})

    schema = "doc_id long, tid int, n long, sid long, ranges array<int>, part int, counts binary"
    both = materialize(docs.select("doc_id", F.hash(text).alias("tid"), F.col(text).alias("text")).mapInPandas(run, schema), "ngram-sets")
    return both.where("part IS NULL").drop("part", "counts"), both.where("part IS NOT NULL").select("part", "counts")


def total(counts: DataFrame) -> np.ndarray:
    """The summed counters: their size is fixed, whatever the corpus.  Rows are added one by one as they stream in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for p, c in zip(frame.part, frame.counts, strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pd.DataFrame({"part": list(sums), "counts": [s.tobytes() for s in sums.values()]})

    out = np.zeros(COUNTERS, np.int64)
    each = COUNTERS // PARTS
    for row in counts.repartition(PARTS, "part").mapInPandas(run, "part int, counts binary").toLocalIterator():
        out[row.part * each : (row.part + 1) * each] += np.frombuffer(row.counts, np.int64)
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, text: str = "text") -> DataFrame:
    """(token, sid, n, pos): the prefix shingles that two or more sets hold in theirs, once per set."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    hot = HOT * max(1.0, float(counts.mean()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value
        for frame in frames:
            tokens, seens, sids, sizes = [], [], [], []
            for t in frame.text:
                g = shingles(t)
                if not len(g):
                    continue
                seen = counts[slot(g)]
                # shingles come sorted, so a stable sort by count breaks ties by hash
                first = np.argsort(seen, kind="stable")[: len(g) - (len(g) * PERCENT + 99) // 100 + 1]
                tokens.append(g[first])
                seens.append(seen[first])
                sids.append(set_id(g))
                sizes.append(len(g))
            if tokens:
                each = np.array([len(x) for x in tokens])
                pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield pd.DataFrame({"token": words.signed(np.concatenate(tokens)), "sid": np.repeat(np.array(sids, np.int64), each), "n": np.repeat(np.array(sizes, np.int32), each),
                                    "pos": pos.astype(np.int32), "hot": np.concatenate(seens) > hot})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(run, "token long, sid long, n int, pos int, hot boolean")
    # a shingle that isn't hot has few rows, so its group is small; hot ones are spread and kept without a test
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("sid"), F.lit(4096))).otherwise(-1))
    within = _over("token", "salt")
    rows = rows.withColumn("a", F.min("sid").over(within)).withColumn("z", F.max("sid").over(within))
    shared = materialize(rows.where("hot OR a < z").select("token", "sid", "n", "pos").distinct(), "ngram-shared")
    many = shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return materialize(shared.join(materialize(many, "ngram-df"), "token"), "ngram-prefixes")


def _over(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def alpha(n: Column, m: Column) -> Column:
    """The least overlap of two linked sets of these sizes."""
    whole = PERCENT * (n + m) + (99 + PERCENT)
    return F.floor(whole / (100 + PERCENT))


def near_sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


class Verifier:
    """Exact comparison of candidate pairs.

    One text per set is stored, bucketed by set, so that a round never shuffles them: it picks those that its filters leave.
    """

    def __init__(self, docs: DataFrame, sets: DataFrame, members: DataFrame, text: str):
        spark = docs.sparkSession
        one = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("d"), F.first("ranges").alias("ranges"), F.first("n").alias("n"))
        one = one.join(members.select("sid").distinct(), "sid", "left_semi")
        self.slim = materialize(one.select("sid", "n", "ranges", "d.doc_id", "d.tid"), "ngram-slim")
        d = self.slim.select("sid", F.col("doc_id").alias("_d"), F.col("tid").alias("_t"))
        texts = docs.select("doc_id", F.hash(text).alias("tid"), F.col(text).alias("text"))
        texts = texts.join(d, texts.doc_id.eqNullSafe(d._d) & (texts.tid == d._t)).select("sid", "text")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"ngram_texts_{uuid.uuid4().hex}"
        texts.repartition(buckets, "sid").dropDuplicates(["sid"]).write.bucketBy(buckets, "sid").saveAsTable(self.name)
        self.texts = spark.table(self.name)

    def close(self) -> None:
        self.texts.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        a, b = (self.slim.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}")) for x in "ab")
        gap = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        left = pairs.join(a, "a").join(b, "b").where(near_sizes(F.col("na"), F.col("nb")) & (gap <= F.col("na") + F.col("nb") - 2 * alpha(F.col("na"), F.col("nb"))))
        left = materialize(left.select("a", "b"), f"{label}-filtered")
        # only the texts of sets in these pairs are sent on
        ids = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        texts = materialize(self.texts.join(ids, "sid", "left_semi"), f"{label}-texts")
        full = left.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keep = []
                for x, y in zip(frame.ta, frame.tb, strict=True):
                    g, h = shingles(x), shingles(y)
                    both = len(np.intersect1d(g, h, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(g) + len(h) - both))
                yield frame.loc[keep, ["a", "b"]]

        out = materialize(full.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), f"{label}-links")
        discard(texts, left)
        return out


def _sweep(df: DataFrame) -> None:
    """Spark deletes shuffle files once the driver's JVM has collected the frames that made them.  Between steps that each shuffle
    much this is asked for, so that the files of finished steps don't add up on disk."""
    df.sparkSession.sparkContext._jvm.System.gc()


def merge(labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """Labels (sid, comp) after links between their components."""
    edge = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a = links.join(labels.select(F.col("sid").alias("a"), F.col("comp").alias("u")), "a")
    edges = materialize(edge(a.join(labels.select(F.col("sid").alias("b"), F.col("comp").alias("v")), "b")), f"{label}-edges")
    step = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), f"{label}-to-{step}")
        labels = materialize(labels.join(to, labels.comp == to.u, "left").select("sid", F.coalesce("w", "comp").alias("comp")), f"{label}-comp-{step}")
        v = to.select(F.col("u").alias("v"), F.col("w").alias("x"))
        edges = materialize(edge(edges.join(to, "u").join(v, "v").select(F.col("w").alias("u"), F.col("x").alias("v"))), f"{label}-edges-{step}")
        step += 1
    return labels


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tid, n_shingles, component_id, comp): a row per row of ``docs``; ``tid`` is the hash of the text, ``comp`` tells components
    apart that share a name, since one id can be on unrelated texts; it is null for empty sets."""
    sets, counts = describe(docs, text)
    tokens = prefixes(docs, total(counts), text)
    _sweep(tokens)
    check = Verifier(docs, sets, tokens, text)
    try:
        labels = materialize(_labels(tokens, check), "ngram-labels")
    finally:
        check.close()

    least = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least")).join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("sid", "component_id", "comp")
    out = sets.join(materialize(named, "ngram-named"), "sid", "left")
    return out.select("doc_id", "tid", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")


def _labels(tokens: DataFrame, check: Verifier) -> DataFrame:
    """(sid, comp) of all sets that share a prefix shingle with another."""
    labels = check.slim.select("sid", F.col("sid").alias("comp"))

    def pivots(r: int) -> DataFrame:
        rows = tokens.join(labels, "sid").withColumn("slot", F.pmod(F.xxhash64("sid", "token", F.lit(r)), F.ceil(F.col("df") / FAN)))
        rank = F.struct("n", "sid", "comp") if r == 0 else F.struct(F.xxhash64("token", "sid", F.lit(r)).alias("h"), "n", "sid", "comp")
        first = rows.groupBy("token", "slot").agg(F.min(rank).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        first = first.select("token", "slot", F.col("p.sid").alias("a"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc"))
        met = rows.join(first, ["token", "slot"]).where((F.col("comp") != F.col("pc")) & near_sizes(F.col("n"), F.col("pn")))
        pairs = met.groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("common"))
        if r:
            return pairs.select("a", "b")
        return pairs.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b")

    for r in range(ROUNDS):
        labels = merge(labels, check.links(materialize(pivots(r), f"ngram-pairs-{r}"), f"ngram-{r}"), f"ngram-{r}")
        _sweep(labels)

    rows = materialize(tokens.join(labels, "sid"), "ngram-members")
    large = rows.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("large"), F.count("*").alias("comps")).where("comps > 1")
    large = materialize(large.drop("comps"), "ngram-large")
    out = rows.join(large, "token").where("comp <> large").select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"), "large")
    out = materialize(out, "ngram-outside")
    other = rows.select(F.col("token").alias("t"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # this shingle and those after it
    pairs = out.join(other, (F.col("token") == F.col("t")) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("large")) | (F.col("a") < F.col("b")))
                     & near_sizes(F.col("na"), F.col("nb")) & (room >= alpha(F.col("na"), F.col("nb"))))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs-last")
    return merge(labels, check.links(pairs, "ngram-last"), "ngram-last")


def representatives(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each component: the one whose id names it.

    Where that id is on several texts of the component, the one with the least hash; where it is on unrelated texts, each of their components keeps its
    own row.  All rows without an id stay.  Of the rows of one id without words, one stays.
    """
    own = docs.columns
    at = "_tid"
    while at in own:
        at += "_"
    found = components(docs, text)
    named = found.where("doc_id = component_id").groupBy("doc_id", "comp").agg(F.min("tid").alias("tid")).select("doc_id", "tid")
    keep = materialize(named.unionByName(found.where("doc_id IS NULL").select("doc_id", "tid")).distinct(), "ngram-keep").toDF("_keep_d", "_keep_t")
    rows = docs.select(*own, F.hash(text).alias(at))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_keep_d"]) & (rows[at] == keep["_keep_t"]), "left_semi")
    once = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", at])
    return once.unionByName(rows.where("doc_id IS NULL")).select(*own)
