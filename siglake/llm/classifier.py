"""Quality classifier trained on weak labels.

Two groups of overlapping heuristic labellers look at every document: one for
junk (symbols, capitals, separators, repetition, function words), one for
toxicity (a fixed list of insults, and two halves of a lexicon whose words
labelled toxic documents use and others don't). Each labeller votes bad, good or
abstains. Per group, expectation-maximisation estimates how often a labeller
casts each vote on bad and on good documents, and with that the probability
that a document with given votes is bad. EM needs only the count of each vote
pattern, at most 3 ** labellers of them, counted over all documents.

The posteriors then label a sample of at most ``train_docs`` documents, those
with the smallest hashes, on which a logistic scorer over hashed words and votes
is trained; every document is scored with its weights. ``lexicon_docs`` bounds
the labelled rows that the lexicon comes from. These two samples are the only
ones; votes, patterns, posteriors and scores cover all documents.

Edge cases. Long texts are read whole by every labeller and by the scorer. Ties:
rows with equal hashes are sampled by their votes and words, which decide what is
learned from them; equal posteriors give equal labels. Null or empty text: every labeller abstains, the row is kept with
the prior's score. Repeated documents: a row each. No labels: the lexicon is
empty. Empty table: no rows. Labels with null toxic are left out. Extra columns
are ignored unless carry names them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siglake.llm.common import ALNUM_GAP, lower_sql, words_sql
from siglake.llm.decontaminate import words_of

DIMENSIONS = 1 << 18
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Insults, and function words of the corpus languages.
INSULTS = {b"idiot", b"moron", b"stupid", b"scum", b"loser", b"trash", b"pathetic", b"worthless", b"disgusting", b"clown", b"dumb", b"imbecile", b"arschloch", b"dummkopf", b"connard", b"salaud", b"pendejo", b"gilipollas"}
FUNCTION_WORDS = {w.encode() for w in "the of and to in is that it for with der die das und ist von zu mit den ein le la les de et des en un une que el los se del por su y".split()}
JUNK = ("symbols", "capitals", "separators", "repetition", "vocabulary", "function_words")
TOXIC = ("insults", "lexicon_even", "lexicon_odd")


def votes_of(text: bytes, words: list[bytes], seen: set[bytes], lexicon: tuple[set, set]) -> tuple[int, ...]:
    """One vote per labeller of JUNK and then TOXIC."""
    n = len(words)
    if not n:
        return (ABSTAIN,) * (len(JUNK) + len(TOXIC))
    size = len(text)
    symbols = (size - len(text.translate(None, b"#*$%&|<>"))) / size
    capitals = (size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size
    separators = (text.count(b" | ") + text.count(b"!!")) / n
    distinct, again = len(seen) / n, sum(map(eq, words, islice(words, 1, None))) / n
    common = sum(1 for w in words if w in FUNCTION_WORDS) / n
    return (
        BAD if symbols > 0.03 else GOOD if symbols < 0.005 else ABSTAIN,
        BAD if capitals > 0.3 else GOOD if capitals < 0.1 else ABSTAIN,
        BAD if separators > 0.2 else GOOD if separators < 0.02 else ABSTAIN,
        BAD if again > 0.1 else GOOD if again < 0.02 else ABSTAIN,
        ABSTAIN if n < 20 or n > 5000 else BAD if distinct < 0.3 else GOOD,
        ABSTAIN if n < 20 else BAD if common < 0.02 else GOOD if common > 0.1 else ABSTAIN,
        *(BAD if not seen.isdisjoint(x) else GOOD for x in (INSULTS, *lexicon)),
    )


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior_bad: float = 0.1, false_alarms: float = 0.0005, faith: float = 10) -> dict[tuple[int, ...], float]:
    """The posterior of "bad" for each pattern. An abstention is a missing vote and says nothing.

    Labellers are made to be right when they say bad: a prior of ``faith`` times the data's weight holds their rate of false alarms near ``false_alarms``."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes, n = np.array(keys), np.array([patterns[k] for k in keys], dtype=float)
    bad, good = votes == BAD, votes == GOOD
    p = np.where(bad.any(1), 0.9, np.where(good.any(1), 0.01, prior_bad))
    for _ in range(rounds):
        logs = []
        for weight, first in ((n * p, (0.2, 0.8)), (n * (1 - p), (faith * n.sum() * false_alarms, faith * n.sum() * (1 - false_alarms)))):
            says_bad, says_good = weight @ bad + first[0], weight @ good + first[1]
            rate = says_bad / (says_bad + says_good)
            logs.append(np.log((weight.sum() + 1) / (n.sum() + 2)) + bad @ np.log(rate) + good @ np.log(1 - rate))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return {k: float(x) for k, x in zip(keys, p)}


def features(seen: set[bytes], votes: tuple[int, ...]) -> np.ndarray:
    ids = {crc32(w) % DIMENSIONS for w in seen}
    ids.update(crc32(b"\0vote %d %d" % (k, v)) % DIMENSIONS for k, v in enumerate(votes))
    return np.fromiter(sorted(ids), dtype=np.int32, count=len(ids))


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad over sparse binary features."""
    w, g, b, gb = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2), 0.0, 1e-2
    for _ in range(epochs):
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            size = np.array([len(x) for x in part])
            ids, row = np.concatenate(part), np.repeat(np.arange(len(part)), size)
            z = b + np.bincount(row, w[ids], minlength=len(part))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at : at + batch]
            grad = np.bincount(ids, err[row], minlength=DIMENSIONS) / len(part) + decay * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
            gb += err.mean() ** 2
            b -= rate * err.mean() / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def toxic_lexicon(documents: DataFrame, labels: DataFrame, lexicon_docs: int) -> list[str]:
    """Words that at least 1 % of the labelled toxic texts hold (4 at least) and hardly another text, in at most lexicon_docs labelled rows; so there are at most a hundred times as many as such a text has."""
    held = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(lexicon_docs)
    texts = documents.select("doc_id", "text").join(F.broadcast(held), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    words = texts.select("toxic", F.explode(F.expr(f"array_distinct({words_sql(lower_sql('text'), ALNUM_GAP)})")).alias("word"))
    n_toxic = texts.where("toxic = 1").count()
    counted = words.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n"))
    found = counted.where(f"bad >= {max(4, n_toxic // 100)} and bad >= 0.95 * n")
    return [r.word for r in found.collect()]


def _looked_at(batches, lexicon, make, schema):
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            text = batch["text"][k].as_py() or b""
            words = words_of(text)
            seen = set(words)
            out.append(make(batch["doc_id"][k].as_py(), seen, votes_of(text, words, seen, lexicon)))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def score(documents: DataFrame, labels: DataFrame, *, train_docs: int = 20_000, lexicon_docs: int = 20_000, threshold: float = 0.5, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named in carry, posterior (of the vote pattern), score (of the linear scorer) and kept for every document."""
    sc = documents.sparkSession.sparkContext
    found = [w.encode() for w in toxic_lexicon(documents, labels, lexicon_docs)]
    lexicon = tuple({w for w in found if crc32(w) % 2 == k} for k in (0, 1))
    todo = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    held = sc.broadcast(lexicon)
    width = len(JUNK) + len(TOXIC)

    def count_votes(batches):
        counted = Counter()
        for batch in _looked_at(batches, held.value, lambda i, s, v: {"pattern": "".join(map(str, v))}, pa.schema([("pattern", pa.string())])):
            counted.update(batch["pattern"].to_pylist())
        yield pa.RecordBatch.from_pydict({"pattern": list(counted), "n": list(counted.values())}, schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    counted = {tuple(map(int, r.pattern)): r.n for r in todo.mapInArrow(count_votes, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior = {}
    parts = [slice(0, len(JUNK)), slice(len(JUNK), width)]
    each = []
    for part in parts:
        merged: Counter = Counter()
        for k, n in counted.items():
            merged[k[part]] += n
        each.append(expectation_maximisation(merged))
    for k in counted:
        posterior[k] = 1 - (1 - each[0][k[parts[0]]]) * (1 - each[1][k[parts[1]]])

    total = sum(counted.values())
    order = F.xxhash64("doc_id", "text", F.lit(17))  # the text too, so that rows without an id are not all in or all out
    chance = int((1 << 30) * min(1.0, 1.1 * train_docs / max(total, 1)))
    sample = todo.withColumn("order", order).where(F.pmod("order", F.lit(1 << 30)) < chance)

    def featured(batches):
        schema = pa.schema([("order", pa.int64()), ("votes", pa.string()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            made = _looked_at([batch], held.value, lambda i, s, v: {"votes": "".join(map(str, v)), "ids": features(s, v)}, schema)
            for part in made:
                yield pa.RecordBatch.from_arrays([batch["order"], part["votes"], part["ids"]], schema=schema)

    def fitted(batches):
        rows, labels = [], []
        for batch in batches:
            flat, ends = batch["ids"].flatten().to_numpy(), np.append(0, np.cumsum(batch["ids"].value_lengths().to_numpy()))
            rows += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            labels += [posterior[tuple(map(int, v))] for v in batch["votes"].to_pylist()]
        weights, bias = train(rows, np.array(labels))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias]})

    # the sample meets in one task, which its size bounds; the driver sees the weights alone
    least = sample.mapInArrow(featured, "order bigint, votes string, ids array<int>").orderBy("order", "votes", "ids").limit(train_docs)
    fit = least.mapInArrow(fitted, "weights binary, bias double").collect()
    weights, bias = np.zeros(DIMENSIONS, np.float32), 0.0
    for row in fit:
        weights, bias = np.frombuffer(row.weights, np.float32), row.bias
    model = sc.broadcast((lexicon, posterior, weights, bias))
    carry = [c for c in carry if c not in ("posterior", "score", "kept")]
    fields = [documents.schema[c] for c in carry]

    def scored(batches):
        lexicon, posterior, weights, bias = model.value
        for batch in batches:
            chance, scores = [], []
            for text in batch["_text"]:
                text = text.as_py() or b""
                words = words_of(text)
                seen = set(words)
                votes = votes_of(text, words, seen, lexicon)
                z = bias + float(np.sort(weights[features(seen, votes)]).sum(dtype=np.float64))
                chance.append(posterior.get(votes, 0.5))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(chance, pa.float64()), pa.array(scores, pa.float64())], names=[*carry, "posterior", "score"])

    schema = StructType([*fields, StructField("posterior", DoubleType()), StructField("score", DoubleType())])
    return documents.select(*carry, F.col("text").cast("binary").alias("_text")).mapInArrow(scored, schema).withColumn("kept", F.col("score") < threshold)
