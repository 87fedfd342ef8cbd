"""Nearest vectors by inner product: a robust-pruned graph for each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import vector_graph
from marketlens.llm.tables import durable

#: Vectors of a shard and queries of a block, about; a task holds one of each.
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
#: Distinct vectors that a task holds while it merges copies.
MERGED_ROWS = 16_384
#: Queries that walk at once.
WALK_ROWS = 256
#: Width of the beam that queries use, wider than the builder's.
SEARCH_BEAM = 128


def usable_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` (doubles) without null, zero and not finite vectors, nor null components or ids."""
    values = F.col("vector")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        .where("id is not null and vector is not null")
        .where(sound & F.exists(values, lambda x: x != 0))
    )


def distinct_vectors(sound: DataFrame, most: int, kind: str) -> DataFrame:
    """``vector, ids`` of every distinct vector, with its ``most`` smallest ids in rising order.

    Each task merges its copies first, so a vector of many rows costs a row or so a task.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list] = {}

        def rows() -> pa.RecordBatch:
            vectors = [np.frombuffer(v) for v in met]
            ids = [sorted(some)[:most] for some in met.values()]
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array(ids, pa.list_(named))], ["vector", "ids"])

        for batch in batches:
            named, vectors = batch.column(0).type, batch.column(1)
            starts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False) + 0.0  # no -0.0
            for name, begin, end in zip(batch.column(0).to_pylist(), starts[:-1], starts[1:]):
                some = met.setdefault(values[begin:end].tobytes(), [])
                some.append(name)
                if len(some) >= 8 * most:
                    some[:] = sorted(some)[:most]
            if len(met) >= MERGED_ROWS:
                yield rows()
        if met:
            yield rows()

    parts = sound.select("id", "vector").mapInArrow(merged, f"vector array<double>, ids array<{kind}>")
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most)
    return parts.groupBy("vector").agg(ids.alias("ids"))


def nearest_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """The ``k`` nearest found of every query, among all rows but those with its own id.

    Rows of equal vectors are one point with its ``k + 1`` smallest ids, which is exact for k
    neighbours. All points are hashed into shards of about ``shard_rows``; each shard gets a directed graph
    whose edges are proposed by greedy searches and pruned for diversity. Blocks of queries walk
    each shard's graph with a beam, and the shards' best are merged. A task holds one shard and one
    block, so memory does not grow with the tables, and both are spread by hashes.

    Returns ``query_id, rank, vec_id, score``, nearest first by inner product of the original
    vectors in double precision, ties to the smaller id; all candidates if there are fewer than k.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids
    and, per comparison, vectors of other lengths than the shard's first. Repeated rows of an id
    are one candidate. Other columns are not read. Results depend on the hashes alone.
    """
    kind = vectors.schema[key].dataType.simpleString()
    sound = usable_vectors(vectors, key, vector).dropDuplicates(["id"])
    asked = usable_vectors(queries, key, vector).dropDuplicates(["id"])
    shards = max(1, -(-sound.agg(F.countDistinct(F.xxhash64("vector"))).first()[0] // shard_rows))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")

    def graph(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(np.array([ids[0] for ids in rows.ids]))]
        points = np.stack(rows.vector.to_numpy())
        edges, entries = vector_graph.build(vector_graph.lifted(points))
        entry = np.zeros(len(rows), bool)
        entry[entries] = True
        return pd.DataFrame({
            "shard": rows.shard, "place": np.arange(len(rows)), "ids": rows.ids, "vector": rows.vector,
            "edges": list(edges.astype(np.int32)), "entry": entry,
        })

    sized = distinct_vectors(sound, k + 1, kind).withColumn("shard", shard).withColumn("width", F.size("vector"))
    index = durable(
        sized.groupBy("shard", "width").applyInPandas(
            graph, f"shard int, place int, ids array<{kind}>, vector array<double>, edges array<int>, entry boolean"
        )
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    parts = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.withColumn("width", F.size("vector")).withColumn("block", parts)
    right = asked.withColumn("width", F.size("vector")).withColumn("block", block).withColumn("shard", numbers)

    def search(graph_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(graph_rows) or not len(query_rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        graph_rows = graph_rows.sort_values("place")
        points, names = np.stack(graph_rows.vector.to_numpy()), graph_rows.ids.to_list()
        copies = np.array([len(ids) for ids in names])
        edges = np.stack(graph_rows.edges.to_numpy()).astype(np.int64)
        lifted, entries = vector_graph.lifted(points), np.flatnonzero(graph_rows.entry.to_numpy())
        wanted, askers = np.stack(query_rows.vector.to_numpy()), query_rows.id.to_numpy()
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for begin in range(0, len(wanted), WALK_ROWS):
            part = wanted[begin : begin + WALK_ROWS]
            flat = np.concatenate([part, np.zeros((len(part), 1))], 1)
            places, _ = vector_graph.beam_search(lifted, edges, flat, entries, max(beam, k + 1))
            for asker, q, met in zip(askers[begin : begin + WALK_ROWS], part, places):
                met = met[met >= 0]
                scores = (points[met] * q).sum(1)
                order = np.argsort(-scores)
                # the points down to the score at which k ids beside the asker's are there
                last = min(np.searchsorted(np.cumsum(copies[met[order]]), k + 1), len(order) - 1)
                enough = order[scores[order] >= scores[order[last]]]
                ids = np.concatenate([names[m] for m in met[enough]])
                scores = np.repeat(scores[enough], copies[met[enough]])[ids != asker]
                ids = ids[ids != asker]
                best = np.lexsort((ids, -scores))[:k]
                found["query_id"].extend([asker] * len(best))
                found["vec_id"].extend(ids[best])
                found["score"].extend(scores[best])
        return pd.DataFrame(found)

    met = left.groupBy("shard", "width", "block").cogroup(right.groupBy("shard", "width", "block")).applyInPandas(
        search, f"query_id {kind}, vec_id {kind}, score double"
    )
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
