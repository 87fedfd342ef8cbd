"""Near-duplicate documents by exact Jaccard similarity of word shingles: a prefix-tree join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.components import components
from marketlens.llm.prefix_tree import PrefixTree, least_overlap, prefix_length
from marketlens.llm.shingles import BINS, bin_of, in_order, set_number, shingle_set
from marketlens.llm.tables import durable, small, task_scoped

WORDS = 5
PERCENT = 80
#: Shingles of the sets that one prefix tree holds; more candidates of a set make more trees.
TREE_SHINGLES = 500_000
#: Rounds of comparing groups with one set each go on while they link this share of the sets.
MERGING = 0.05
#: Sets of each group that the last round compares with the others.
PIVOTS = 8
#: Shingles whose bins are counted at once.
BIN_LOT = 1 << 20
#: Sets of one block of a group.
GROUP_SETS = 4_096


def _profiled(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """A row for each document (key, n, set_number), and one with bin counts for each task."""
    kind = documents.schema[key].dataType.simpleString()

    @task_scoped
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)
        names = ["key", "n", "set_number", "bins"]
        for batch in batches:
            # text by text: a set is counted into bins in bounded lots and then let go
            sizes, numbers, waiting, held = [], [], [], 0
            for body in batch.column(1).to_pylist():
                found = shingle_set(body, words)
                sizes.append(len(found))
                numbers.append(set_number(found))
                waiting.append(bin_of(found))
                held += len(found)
                if held > BIN_LOT:
                    bins += np.bincount(np.concatenate(waiting), minlength=BINS)
                    waiting, held = [], 0
            if waiting:
                bins += np.bincount(np.concatenate(waiting), minlength=BINS)
            made = [batch.column(0), sizes, numbers, [None] * len(sizes)]
            yield _batch(names, made, [batch.column(0).type, pa.int64(), pa.int64(), pa.binary()])
        if bins.any():
            kind_of_key = batch.column(0).type
            made = [[None], [-1], [None], [bins.tobytes()]]
            yield _batch(names, made, [kind_of_key, pa.int64(), pa.int64(), pa.binary()])

    return documents.select(key, text).mapInArrow(
        run, f"key {kind}, n long, set_number long, bins binary"
    )


def _batch(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names
    )


def _bin_ranks(counts: DataFrame) -> np.ndarray:
    """Rank of each bin by its count over all documents: ``BINS`` numbers, whatever the input."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                bins = np.frombuffer(packed, np.int64)
                here = np.flatnonzero(bins)
                yield _batch(["bin", "n"], [pa.array(here), pa.array(bins[here])], [pa.int64(), pa.int64()])

    sums = counts.mapInArrow(unpacked, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BINS, np.int64)
    total[sums["bin"].to_numpy()] = sums["n"].to_numpy()
    rank = np.empty(BINS, np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(BINS, dtype=np.uint64)
    return rank


def similar_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The size of each document's shingle set and its class of linked documents.

    Two documents link when ``100 * intersection >= percent * union`` of their sets. Every set is
    put in one global order of its shingles, rare ones first by counts over the whole corpus in a
    fixed number of bins. Linked sets share one of the first ``n - ceil(n * percent / 100) + 1``
    shingles of each, so only sets that meet there are compared, and only if their first ones share
    enough for the rest to suffice. In rounds, each such group compares its smallest set with the
    others that belong to other classes so far; that set is then done, and groups that lie in one
    class drop out. So copies and near copies collapse first, without their pairs. When rounds no
    longer link much, the sets that still meet across classes are compared in blocks. Comparing
    walks a prefix tree of a bounded block (``prefix_tree``) with the whole of both sets, so links
    are exact.

    Returns ``key, n_shingles, component_id``: the smallest key reachable over links, its own
    included. Documents with null or empty text, or white space alone, have no shingles, link with
    nothing and are their own class. Copies of a text share a class. Rows that repeat a key are
    kept, each with its own set; a row with a null key is a class alone, with a null component.
    Other columns are not read. Sets are told apart by 64-bit numbers: for m distinct sets the
    chance that any two are taken for one is below m * m / 2**65.
    """
    profile, grouped, least = _classes(documents, key, text, words, percent)
    alone = profile.where("key is null or set_number is null").select("key", "n", F.col("key").alias("least"))
    return (
        grouped.join(least, "component").select("key", "n", "least").unionByName(alone)
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    )


def _classes(documents: DataFrame, key: str, text: str, words: int, percent: int):
    """``profile`` (key, n, set_number) of every row, ``grouped`` (key, n, set_number, component) of
    the rows with a key and shingles, and ``least`` (component, least): the smallest key of each."""
    context = documents.sparkSession.sparkContext
    raw = durable(_profiled(documents, key, text, words))
    profile = raw.where("n >= 0").select("key", "n", "set_number")
    rank = context.broadcast(_bin_ranks(raw.where("n < 0").select("bins")))
    classes = _set_classes(documents, profile, key, text, words, percent, rank)
    grouped = profile.where("key is not null and set_number is not null").join(classes, "set_number", "left")
    grouped = grouped.select("key", "n", "set_number", F.coalesce("component", "set_number").alias("component"))
    least = grouped.groupBy("component").agg(F.min("key").alias("least"))
    return profile, grouped, least


def _set_classes(
    documents: DataFrame, profile: DataFrame, key: str, text: str, words: int, percent: int, rank
) -> DataFrame:
    """``set_number, component`` of the sets that have links."""

    @task_scoped
    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, heads = [], [], []
            for body in batch.column(0).to_pylist():
                found = shingle_set(body, words)
                n = len(found)
                if n:
                    sizes.append(n)
                    numbers.append(set_number(found))
                    heads.append(in_order(found, rank.value)[: prefix_length(n, percent)].view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield _batch(
                ["set_number", "n", "head"],
                [numbers, sizes, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                [pa.int64(), pa.int64(), pa.list_(pa.int64())],
            )

    heads = documents.where(F.col(key).isNotNull()).select(text).mapInArrow(
        first_ones, "set_number long, n long, head array<long>"
    )
    postings = heads.select("set_number", "n", F.explode("head").alias("shingle"))
    shared = postings.groupBy("shingle").count().where("count > 1").select("shingle")
    members = postings.join(shared, "shingle").groupBy("shingle", "set_number").agg(F.min("n").alias("n"))
    live = durable(_mixed(members, None))
    sets = _Sets(documents, profile, key, text, words, percent, rank)
    heads = durable(live.groupBy("set_number").agg(F.collect_list("shingle").alias("head")))  # a set's own prefix
    known, pivots = None, 1
    while not live.isEmpty():
        chosen = live.where(F.col("place") <= pivots).select(
            "shingle", F.col("set_number").alias("pivot"), F.col("n").alias("m"), F.col("component").alias("other")
        )
        if pivots == 1:  # the group's first set is with each of its rows
            met = live.select("*", F.col("first.set_number").alias("pivot"), F.col("first.n").alias("m"), F.col("first.component").alias("other"))
        else:
            met = live.join(chosen, "shingle")
        pairs = durable(
            met.where("set_number > pivot and component <> other")
            .where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
            .select(F.col("set_number").alias("member"), "n", "pivot", "m").distinct()
        )
        links = durable(sets.star_links(durable(_enough_in_prefix(pairs, heads, percent))))
        found = links.count()
        known = _merged(known, links) if found else known
        little = found <= MERGING * live.select("set_number").distinct().count()
        live = durable(_mixed(live.where(F.col("place") > pivots), known))
        if pivots > 1:
            break
        if little:
            pivots = PIVOTS
    if not live.isEmpty():
        links = durable(sets.block_links(live))
        known = known if links.isEmpty() else _merged(known, links)
    if known is None:
        return documents.sparkSession.createDataFrame([], "set_number long, component long")
    return known


def _mixed(groups: DataFrame, known: DataFrame | None) -> DataFrame:
    """Members of the groups that hold more than one class, with their class so far, their place in
    the group and the group's first member; one shuffle, or none if the groups are together."""
    members = groups.select("shingle", "set_number", "n")
    if known is None:
        members = members.withColumn("component", F.col("set_number"))
    else:
        members = members.join(small(known, known.count()), "set_number", "left").withColumn(
            "component", F.coalesce("component", "set_number")
        )
    ordered = Window.partitionBy("shingle").orderBy("set_number")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        members.withColumn("place", F.row_number().over(ordered))
        .withColumn("low", F.min("component").over(whole)).withColumn("high", F.max("component").over(whole))
        .withColumn("first", F.first(F.struct("set_number", "n", "component")).over(whole))
        .where("low < high").drop("low", "high")
    )


def _merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes after some more links; the classes so far are links of their members."""
    if known is not None:
        links = links.unionByName(known.select(F.col("set_number").alias("a"), F.col("component").alias("b")))
    return durable(components(links).withColumnRenamed("node", "set_number"))


def _enough_in_prefix(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share enough. Of two linked sets, the one whose prefix ends first has all
    it shares outside the common part of the prefixes behind its own prefix."""
    def tail(n: str) -> str:
        return f"({n} - ({n} + 1 - cast(ceil({n} * {percent} / 100) as long)))"

    need = f"cast(ceil({percent} * (n + m) / {100 + percent}) as long) - greatest({tail('n')}, {tail('m')})"
    rows = small(pairs, pairs.count())
    return (
        heads.join(rows, F.col("set_number") == F.col("member")).drop("set_number")
        .join(heads.select(F.col("set_number").alias("pivot"), F.col("head").alias("other")), "pivot")
        .where(F.size(F.array_intersect("head", "other")) >= F.expr(need))
        .select("pivot", "member", "n", "m")
    )


class _Sets:
    """Fetches whole sets by their numbers and compares them by prefix trees."""

    def __init__(self, documents, profile, key, text, words, percent, rank):
        self.documents, self.profile, self.key, self.text = documents, profile, key, text
        self.words, self.percent, self.rank = words, percent, rank

    def fetched(self, jobs: DataFrame, narrow: bool) -> DataFrame:
        """``jobs`` with the ``shingles`` of their ``set_number``, in falling order.

        One document of each wanted set is read again; its sets are not kept in between. ``narrow``
        jobs are a few numbers a row, so a counted number of them may be broadcast.
        """
        words, rank = self.words, self.rank
        owners = durable(
            self.profile.join(jobs.select("set_number").distinct(), "set_number")
            .groupBy("set_number").agg(F.min("key").alias(self.key))
        )
        texts = self.documents.select(self.key, self.text).join(small(owners, owners.count()), self.key)

        @task_scoped
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, sets = [], []
                for body, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = shingle_set(body, words)
                    if set_number(found) == number:  # a repeated key may have other texts
                        numbers.append(number)
                        sets.append(in_order(found, rank.value)[::-1].tobytes())
                yield _batch(["set_number", "shingles"], [numbers, sets], [pa.int64(), pa.binary()])

        sets = texts.select(self.text, "set_number").mapInArrow(whole, "set_number long, shingles binary")
        jobs = small(jobs, jobs.count()) if narrow else jobs
        return sets.join(jobs, "set_number")  # a repeated row gives repeated sets

    def star_links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, as ``a, b``: each pivot walks trees of bounded blocks of its members."""
        percent = self.percent
        blocks = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / TREE_SHINGLES).alias("blocks"))
        members = pairs.join(blocks, "pivot").select(
            "pivot", F.pmod(F.xxhash64("member"), "blocks").alias("block"), F.col("member").alias("set_number")
        )
        own = members.select("pivot", "block", F.col("pivot").alias("set_number")).distinct()
        rows = self.fetched(durable(members.unionByName(own)), narrow=True)

        def walk(job: tuple, held: dict[str, list]) -> tuple[list, list]:
            at = held["set_number"].index(job[0])
            query = held["shingles"].pop(at)
            names = [n for i, n in enumerate(held["set_number"]) if i != at]
            hits = PrefixTree(held["shingles"]).similar(query, percent)
            return [job[0]] * len(hits), [names[i] for i in hits]

        return _per_job(rows.select("pivot", "block", "set_number", "shingles"), 2, walk)

    def block_links(self, live: DataFrame) -> DataFrame:
        """Links, as ``a, b``, between members of live groups that are of different classes.

        First every group, cut into blocks of bounded size, finds which classes have members that
        share enough of their prefixes; classes that meet so, over any number of steps, form a
        cluster. Then clusters are cut into blocks, every two of which make a job, so that a whole
        set is sent once for each block of its cluster and not for each group.
        """
        percent = self.percent
        heads = live.groupBy("set_number").agg(
            F.first("n").alias("n"), F.first("component").alias("component"), F.collect_list("shingle").alias("head")
        )
        sizes = live.groupBy("shingle").agg(F.ceil(F.count("*") / GROUP_SETS).alias("blocks"))
        met = live.select("shingle", "set_number").join(sizes, "shingle").join(heads, "set_number")
        columns = ("low", "high", "own", "set_number", "n", "component", "head")
        edges = _per_job(
            _block_pairs(met).select("shingle", *columns), 3,
            lambda job, held: _cross_links(job[1], job[2], held, percent, whole=False),
        )
        clusters = components(durable(edges.distinct()))
        members = heads.join(
            clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component"
        )
        sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / TREE_SHINGLES).alias("blocks"))
        jobs = durable(_block_pairs(members.join(sizes, "cluster")).select("cluster", *columns))
        return _per_job(
            self.fetched(jobs, narrow=False).select("cluster", *columns, "shingles"), 3,
            lambda job, held: _cross_links(job[1], job[2], held, percent),
        )


def _block_pairs(members: DataFrame) -> DataFrame:
    """Deals members into ``blocks`` by hash and sends each to all pairs of blocks with its own."""
    own = F.pmod(F.xxhash64("set_number"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (
        members.withColumn("own", own).withColumn("other", other)
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    )


def _per_job(rows: DataFrame, keys: int, work) -> DataFrame:
    """``work(job, columns of its rows)`` for each job, whose key is in the first columns: ``a, b``.

    Rows are dealt by the key and sorted, so a task holds one bounded job at a time.
    """
    names = rows.columns

    @task_scoped
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            a, b = work(at, held)
            return _batch(["a", "b"], [a, b], [pa.int64(), pa.int64()])

        at, held, seen = None, {}, set()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: keys]]
            rest = {n: _values(batch.column(keys + i)) for i, n in enumerate(names[keys:])}
            for row, job in enumerate(zip(*columns)):
                if job != at:
                    if at is not None:
                        yield done()
                    at, held, seen = job, {n: [] for n in rest}, set()
                if rest["set_number"][row] in seen:
                    continue
                seen.add(rest["set_number"][row])
                for n, values in rest.items():
                    held[n].append(values[row])
        if at is not None:
            yield done()

    return rows.repartition(*names[:keys]).sortWithinPartitions(*names[:keys]).mapInArrow(run, "a long, b long")


def _values(column: pa.Array) -> list:
    """Python values; arrays of numbers for lists and packed sets."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]
    if pa.types.is_list(column.type):
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return column.to_pylist()


def _cross_links(low: int, high: int, held: dict[str, list], percent: int, whole: bool = True) -> tuple[list, list]:
    """Links between two blocks, or within one, that join classes not joined before in this job.

    Members of the prefixes are counted through an inverted list; who shares enough of them is
    looked up in the prefix tree of the block. Not ``whole``: the classes that share enough.
    """
    own = np.array(held["own"])
    left = np.flatnonzero(own == low)
    right = np.flatnonzero(own == high)
    if not len(left) or not len(right):
        return [], []
    names, sizes = held["set_number"], np.array(held["n"], np.int64)
    first_class = np.array(held["component"], np.int64)
    class_of = first_class.copy()
    tails = sizes - prefix_length(sizes, percent)
    tree = PrefixTree([held["shingles"][i] for i in right]) if whole else None
    shingles = np.concatenate([held["head"][i] for i in right])
    owners = np.repeat(np.arange(len(right)), [len(held["head"][i]) for i in right])
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], owners[order]
    a, b = [], []
    for place, i in enumerate(left):
        starts = np.searchsorted(shingles, held["head"][i], "left")
        ends = np.searchsorted(shingles, held["head"][i], "right")
        met = [owners[s:e] for s, e in zip(starts, ends) if e > s]
        if not met:
            continue
        common = np.bincount(np.concatenate(met), minlength=len(right))
        n, m = sizes[i], sizes[right]
        need = np.maximum(1, least_overlap(n, m, percent) - np.maximum(tails[i], tails[right]))
        fit = (common >= need) & (class_of[right] != class_of[i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if low == high:
            fit[: place + 1] = False
        among = np.flatnonzero(fit)
        if not len(among):
            continue
        for hit in tree.similar(held["shingles"][i], percent, among) if whole else among:
            j = right[hit]
            if class_of[j] != class_of[i]:
                a.append(names[i] if whole else int(first_class[i]))
                b.append(names[j] if whole else int(first_class[j]))
                class_of[class_of == class_of[j]] = class_of[i]
    return a, b


def one_of_each(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Documents without the near copies of an earlier one: the smallest key of each class stays.

    A row is judged by its key and its own shingle set: it goes if the class of its set holds a
    smaller key, and of rows that repeat both key and set one stays. Rows of one key with sets in
    different classes are judged each on its own; rows without shingles (null, empty or blank text)
    or without a key link with nothing and all stay. All columns pass through.
    """
    _, grouped, least = _classes(documents, key, text, words, percent)
    tag, number, smallest = "_one_of_each_set", "_one_of_each_number", "_one_of_each_least"
    leasts = durable(
        grouped.join(least, "component").select(F.col("set_number").alias(number), F.col("least").alias(smallest)).distinct()
    )
    tagged = _with_set_numbers(documents, key, text, words, tag)
    judged = tagged.join(leasts, tagged[tag] == leasts[number], "left")
    plain = F.col(tag).isNull() | F.col(key).isNull()
    first = judged.where(~plain & (F.col(smallest) == F.col(key))).dropDuplicates([key, tag])
    return judged.where(plain).select(documents.columns).unionByName(first.select(documents.columns))


def _with_set_numbers(documents: DataFrame, key: str, text: str, words: int, tag: str) -> DataFrame:
    """All columns and ``tag``: the number of the row's shingle set, null without shingles."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*documents.schema.fields, StructField(tag, LongType())])
    at = documents.columns.index(text)

    @task_scoped
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [set_number(shingle_set(body, words)) for body in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, tag])

    return documents.mapInArrow(run, schema)
