"""Queries of the per-read kernels. Dynamic programs have no SQL form; tests hold them against published values and small brute-force versions."""

from __future__ import annotations

import numpy as np
import pandas as pd

from siglake.operators import kernels as K
from siglake.plans.registry import query
from siglake.plans.views import BASES

SCHEMAS = {
    "events": "read_id long, start array<long>, length array<float>, mean array<float>, stdv array<float>",
    "aligned": "read_id long, n_aligned long, avg_emission double, passed boolean, ss string",
    "hmm": "read_id long, log_lik double",
    "walk": "read_id long, event array<long>, ref_pos array<long>, states string",
    "path": "read_id long, log_lik double, states string",
}


def signals(spark, sf):
    """Reads with 64 samples from embeddings, spread over the range of a pore."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as read_id", "transform(embedding, (v, i) -> cast(90 + 40 * v + 12 * (i div 8 % 3) as float)) as samples")


def per_read(df, schema, kernel):
    """One output row per read; a batch of reads is in memory at a time."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([kernel(r) for r in batch.to_dict("records")], columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


def model(k: int = 5):
    """A made-up pore model: level and deviation by rank."""
    rank = np.arange(4**k)
    return (60 + (rank * 37 % 101) * 0.7).astype(np.float32), (1.5 + rank % 5 * 0.3).astype(np.float32)


def sequence_of(read_id: int, n: int) -> str:
    return "".join(BASES[(read_id * 7 + i * i + 3 * i) % 26] for i in range(n))


@query()
def events_kernel(spark, sf):
    def kernel(r):
        e = K.detect_events(r["samples"])
        return r["read_id"], e["start"], e["length"], e["mean"], e["stdv"]

    return per_read(signals(spark, sf), SCHEMAS["events"], kernel)


@query()
def abea(spark, sf):
    level, stdv = model()

    def kernel(r):
        e = K.detect_events(r["samples"])
        ranks = K.kmer_ranks(sequence_of(r["read_id"], max(8, len(e["mean"]) // 2 + 5)), 5)
        a = K.align(e["mean"], ranks, level, stdv, *K.scale_by_moments(e["mean"], level[ranks]))
        start, stop, _ = K.map_bases(a["kmer"], a["event"], len(ranks))
        n = len(a["kmer"])
        return r["read_id"], n, a["sum_emission"] / n if n else None, a["ok"], K.step_string(start, stop, e["length"])

    return per_read(signals(spark, sf), SCHEMAS["aligned"], kernel)


def _profile(r, path):
    level, stdv = model()
    e = K.detect_events(r["samples"])["mean"]
    ranks = K.kmer_ranks(sequence_of(r["read_id"], max(8, len(e) // 2 + 5)), 5)
    return K.profile_hmm(e, level[ranks], stdv[ranks], 0.0, 1.0, 1.0, max(1.2, len(e) / len(ranks)), flank=not path, path=path)


@query()
def hmm_forward(spark, sf):
    return per_read(signals(spark, sf), SCHEMAS["hmm"], lambda r: (r["read_id"], _profile(r, False)))


@query()
def viterbi(spark, sf):
    def kernel(r):
        score, path = _profile(r, True)
        return r["read_id"], score, "".join(s for _, _, s in path)

    return per_read(signals(spark, sf), SCHEMAS["path"], kernel)


@query()
def event_walk(spark, sf):
    """Events of a read along its own sequence, from the banded alignment to the stretches' best paths."""
    level, stdv = model()

    def kernel(r):
        e = K.detect_events(r["samples"])["mean"]
        ranks = K.kmer_ranks(sequence_of(r["read_id"], max(8, len(e) // 2 + 5)), 5)
        shift, scale = K.scale_by_moments(e, level[ranks])
        a = K.align(e, ranks, level, stdv, shift, scale)
        start, _, per_base = K.map_bases(a["kmer"], a["event"], len(ranks))
        mapped = np.flatnonzero(start >= 0)
        if not len(mapped):
            return r["read_id"], [], [], ""
        near = start[mapped[np.maximum(np.searchsorted(mapped, np.arange(len(ranks)), side="right") - 1, 0)]]
        at = np.arange(len(ranks) + 4)
        events, positions, states = K.walk_events(at, at, near, ranks, 0, (level, stdv), (shift, scale, 1.0, max(1.2, per_base)), e, 5)
        return r["read_id"], events, positions, "".join(states)

    return per_read(signals(spark, sf), SCHEMAS["walk"], kernel)
