"""Near duplicates among embeddings by randomised-rotation binary codes.

Vectors of one label link at a cosine of ``least`` or more.

1. Equal vectors of a label become one node, so copies cost nothing further.
2. A node's unit vector is turned by seeded random rotations (signs and
   Hadamard transforms, three times). The signs of the turned vector are its
   code; stored beside it is how much of each turned vector its signs keep, the
   correction factor.
3. Bands of the code's bits are the index. Vectors at the angle of ``least``
   differ in a bit with probability angle / pi, so that a band of k bits agrees
   with probability (1 - angle / pi) ** k; as many bands are taken as miss such
   a pair with probability ``missed`` at most. k follows from the size of the
   largest label, so that unlike vectors seldom share a band, whatever the size.
   Every vector is in every band, and no bucket has a cap.
4. A bucket is dealt into blocks of about BLOCK vectors, and each two blocks of
   it meet in one run of rows, so a task holds two blocks at most. For every two
   vectors of a run the inner product of one vector's signs and the other's
   turned vector, over the correction factor, is an unbiased estimate of the
   cosine. Pairs whose upper confidence bound reaches ``least`` are computed anew
   in double precision, and only that decides a link. A pair counts in the first
   of its bands alone.
5. Of a run come a count of links and one edge for each vector, not its pairs.

Vectors a third of which are near copies of one another still take time by the
square of that group, in blocks, as their links are counted one by one; what is
written grows by the number of blocks.

Edge cases. Null label, null or empty vector, a null, NaN or infinite component,
zero length: linked with nothing, a component of its own. Vectors of different
dimensions don't link. Components so large or small that squares overflow or
vanish: the vector is first divided by its largest component. Repeated rows are
vectors of their own, linked as equal. Null vec_id: counted as a vector; a
component's id is its smallest vec_id, null if none has one, and kept is then
false. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import checked_broadcast, materialize
from siglake.llm.shingles import components

BLOCK = 1024
#: Deviations of the estimate's error beyond which a pair is ruled out.
SURE = 5.0
SEED = 7
#: Pairs computed anew at once.
CHUNK = 1 << 15
#: The side of rows whose block meets itself.
ALONE = 2
#: What tells runs apart; buckets are hashes, so a few hold several labels or bands.
RUN = ["bucket", "run", "label", "dim", "band"]


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def turned(unit: np.ndarray, rotation: int) -> np.ndarray:
    """Rows turned by a random rotation, which the number of dimensions and of the rotation give."""
    n, dim = unit.shape
    size = padded(dim)
    out = np.zeros((n, size))
    out[:, :dim] = unit
    rng = np.random.default_rng([SEED, dim, rotation])
    for _ in range(3):
        out *= rng.integers(0, 2, size) * 2.0 - 1.0
        step = 1
        while step < size:  # Hadamard transform
            pairs = out.reshape(n, size // (2 * step), 2, step)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
            step *= 2
        out /= math.sqrt(size)
    return out


def bands(least: float, bits: int, missed: float) -> int:
    """How many bands of so many bits miss a pair at the cosine least with probability missed at most."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(missed) / math.log1p(-agree)))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def coded(unit: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (rows, rotations, size) as -1 and 1, the turned rows, and the correction factors (rows, rotations)."""
    whole = np.stack([turned(unit, r) for r in range(rotations)], axis=1)
    signs = np.where(whole >= 0, 1.0, -1.0)
    factor = np.einsum("nrs,nrs->nr", signs, whole) / math.sqrt(whole.shape[2])
    return signs, whole, factor


def nodes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, digest, null where a vector links with nothing), and nodes (id, digest, label, dim, vector, rep, copies)."""
    finite = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    sound = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    d = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.when(sound, F.col("embedding").cast("array<double>")).alias("v"))

    def packed(batches):
        for batch in batches:
            held = []
            for v in batch["v"]:
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else None
                held.append(None if x is None else (x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(held, pa.binary())], names=["vec_id", "label", "vector"])

    kind = d.schema["vec_id"].dataType.simpleString()
    d = d.mapInArrow(packed, f"vec_id {kind}, label string, vector binary")
    d = materialize(d.withColumn("digest", F.when(F.col("vector").isNotNull(), F.unhex(F.sha2(F.concat(F.octet_length("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("label").cast("binary"), "vector"), 256)))), "vectors")
    rows = d.where("digest is not null").groupBy("digest").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = rows.select(F.monotonically_increasing_id().alias("id"), "digest", "label", F.expr("octet_length(vector) div 8").alias("dim"), "vector", "rep", "copies")
    return d.select("vec_id", "digest"), materialize(nodes, "vector-nodes")


def band_rows(nodes: DataFrame, bits: int, count: int) -> DataFrame:
    """id, copies, vector, keys (its value in each band, as bytes), factors and signs, as stored for the runs."""

    def codes(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rotations = -(-bits * count // padded(int(dim)))
                signs, _, factor = coded(unit_rows(part["vector"].to_pylist()), rotations)
                flat = (signs > 0).reshape(part.num_rows, -1)
                weight = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
                keys = flat[:, : bits * count].reshape(part.num_rows, count, bits) @ weight
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["label"], part["dim"], part["copies"], part["vector"], pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in np.packbits(flat, axis=1)], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in factor], pa.binary())],
                    names=["id", "label", "dim", "copies", "vector", "keys", "signs", "factors"],
                )

    return materialize(nodes.select("id", "label", "dim", "copies", "vector").mapInArrow(codes, "id bigint, label string, dim bigint, copies bigint, vector binary, keys array<bigint>, signs binary, factors binary"), "codes")


def _near(own, other, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices into own and other of the pairs at least or more. Sides: unit rows, turned rows, signs, factors."""
    (u, _, signs, factor), (v, whole, _, _) = own, other
    rotations, size = whole.shape[1:]
    # mean of independent estimates, one a rotation; what each may be off by is in its correction factor
    weighted = signs / (factor[:, :, None] * rotations * math.sqrt(size))
    estimate = weighted.reshape(len(u), -1) @ whole.reshape(len(v), -1).T
    bound = SURE * np.sqrt(((1 - factor**2) / factor**2).sum(axis=1) / (size - 1)) / rotations
    a, b = np.nonzero(estimate + bound[:, None] >= least)
    keep = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), CHUNK):
        keep[k : k + CHUNK] = np.einsum("ij,ij->i", u[a[k : k + CHUNK]], v[b[k : k + CHUNK]]) >= least
    return a[keep], b[keep]


def lowest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vectors the lowest it is linked with along pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(runs: DataFrame, least: float) -> DataFrame:
    """id, links (with copies), linked (another node of its component) from rows in runs. runs: sorted by RUN; side: 0 or 1 by block, ALONE where a block meets itself."""

    def walk(batches):
        at, rows = None, []

        def settled(rows):
            ids, copies, keys, side = (np.array([r[k] for r in rows]) for k in range(4))
            sides = [np.stack([r[k] for r in rows]) for k in range(5, 9)]  # unit, turned, signs, factors
            if side[0] == ALONE:
                a, b = _near(sides, sides, least)
                a, b = a[a < b], b[a < b]
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                a, b = _near([x[left] for x in sides], [x[right] for x in sides], least)
                a, b = left[a], right[b]
            band, fresh = rows[0][4], np.ones(len(a), dtype=bool)
            for k in range(0, len(a), CHUNK):  # not where an earlier band has them together
                fresh[k : k + CHUNK] = ~(keys[a[k : k + CHUNK], :band] == keys[b[k : k + CHUNK], :band]).any(axis=1)
            a, b = a[fresh], b[fresh]
            if not len(a):
                return ids[:0], ids[:0], ids[:0]
            links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            some = np.flatnonzero(links)
            return ids[some], links[some].astype(np.int64), ids[lowest_linked(len(rows), a, b)[some]]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["id", "links", "linked"])

        for batch in batches:
            found, dims = [], batch["dim"].to_numpy()
            made = [None] * batch.num_rows
            for dim in np.unique(dims):  # a batch's vectors are turned at once
                where = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(where))
                unit = unit_rows(part["vector"].to_pylist())
                factor = np.stack([np.frombuffer(x, dtype="<f8") for x in part["factors"].to_pylist()])
                bits = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in part["signs"].to_pylist()]), axis=1)
                signs = (bits[:, : factor.shape[1] * padded(int(dim))].astype(np.float32) * 2 - 1).reshape(len(where), factor.shape[1], -1)
                whole = np.stack([turned(unit, r).astype(np.float32) for r in range(factor.shape[1])], axis=1)
                for k, *x in zip(where, unit, whole, signs, factor):
                    made[k] = x
            columns = [batch[c].to_pylist() for c in ("id", "copies", "keys", "side", "band")]
            for key, x, *row in zip(zip(*(batch[c].to_pylist() for c in RUN)), made, *columns):
                if key != at and rows:
                    found.append(settled(rows))
                    rows = []
                at = key
                rows.append([*row, *x])
            if found:
                yield out(found)
        if rows:
            yield out([settled(rows)])

    return runs.mapInArrow(walk, "id bigint, links bigint, linked bigint")


def near_vectors(embeddings: DataFrame, *, least: float, missed: float = 1e-3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    rows, nodes = nodes_of(embeddings)
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = min(62, max(8, (4 * most).bit_length()))
    count = bands(least, bits, missed)
    codes = band_rows(nodes, bits, count)
    bucket = F.xxhash64("label", "dim", "band", "value")
    members = codes.select("id", "label", "dim", F.posexplode("keys").alias("band", "value")).select("id", "band", bucket.alias("bucket"))
    members = materialize(members, "bands")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    dealt = members.join(sizes, "bucket").select("id", "band", "bucket", blocks.alias("blocks")).withColumn("block", F.expr("pmod(xxhash64(id, bucket), blocks)"))
    # block x meets itself and each other block once: run (x, y) with x <= y
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda y: F.struct(F.least("block", y).alias("x"), F.greatest("block", y).alias("y"), F.when(F.col("block") == y, ALONE).otherwise((F.col("block") > y).cast("int")).alias("side"))))
    runs = dealt.select("id", "band", "bucket", "blocks", meets.alias("m")).select("id", "band", "bucket", F.expr("m.x * blocks + m.y").alias("run"), "m.side")
    runs = runs.join(codes, "id").repartition("bucket", "run").sortWithinPartitions(*RUN)
    found = materialize(compared(runs, least), "links")
    label = components(found.select(F.col("id").alias("a"), F.col("linked").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.select("id", "digest", "rep", "copies").join(links, "id", "left").join(label, "id", "left")
    named = materialize(named.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = checked_broadcast(materialize(named.join(smallest, "label").select("digest", "n_links", "component_id"), "components"))
    out = rows.join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
