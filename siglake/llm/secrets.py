"""Secret scans with multipart credential linking.

Base finds of three kinds (assign, access, hex) are always reported. Beside
them the text is searched for weak candidates, which mean little alone: names
of accounts (``ident``), short or oddly named secrets (``weak``) and
``endpoint``s. Every find has a role: identifier, secret or endpoint. A weak
candidate is reported only where a find of another role lies in its scope, the
``reach`` code points on either side.

One pass over the texts writes the lengths of the finds and of the pieces
between them, as Spark has no function for the places of all matches; from
there on only these small rows are shuffled. Running sums give the places, and
an interval join links the parts: finds are dealt into bins of one reach, a
weak candidate looks into the bins its scope touches, and the pairs of one bin
are held against the scope. Finds of one kind don't overlap and have a least
length, so a scope holds a bounded number of them and the pairs grow with the
finds.

Edge cases. Null or empty text: no finds, the digest of an empty string.
Repeated documents: a row each, also where doc_id is null. Ties (two kinds at
one start): in the order of the kinds. Very long texts: cost grows with the
length and the finds. Empty table: no rows. A weak candidate that overlaps a
base find is not reported. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import materialize

BASE_KINDS = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "weak": "secret", "endpoint": "endpoint"}
KINDS = tuple(ROLES)
REACH = 200


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(?:" + "|".join(either_case(w) for w in words) + ")"


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern with the value as group 1, least length of the value)
PATTERNS = {
    "assign": ("(?:" + "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"), either_case("api") + "_?" + either_case("key")]) + ")" + _GIVEN + "([A-Za-z0-9+/_.=-]+)", 6),
    "access": ("(AKIA[A-Z0-9]+)", 20),
    "hex": ("([0-9a-f]+)", 24),
    "ident": (_names("username", "user_id", "client_id", "account_id", "login", "access_key_id") + _GIVEN + r"([A-Za-z0-9_.@-]+)", 3),
    "weak": (_names("pwd", "auth", "credential", "private_key", "signature") + _GIVEN + r"([A-Za-z0-9+/_.=-]+)", 4),
    "endpoint": (r"((?:https?|jdbc|ssh|amqp|redis)[:][/][/][^\x00-\x20<>]+|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})", 7),
}
#: For speed alone: every match of "hex" that counts is a whole run of this kind, so shorter runs need not be matched.
FAST = {"hex": "([0-9a-f]{24,})"}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_lengths(text: str, kind: str) -> str:
    """SQL: array of (k, i, gap, size, value), one for each match of the kind in order: lengths of the text before it, of the match and of its value; null if there is none."""
    pattern, _ = PATTERNS[kind]
    p = _quoted(FAST.get(kind, pattern))
    sizes = f"transform(regexp_extract_all({text}, {p}, 0), m -> length(m))"
    values = sizes if pattern.startswith("(") and not pattern.startswith("(?") else f"transform(regexp_extract_all({text}, {p}, 1), v -> length(v))"
    zipped = f"filter(arrays_zip(transform(split({text}, {p}, -1), g -> length(g)), {sizes}, {values}), x -> x['1'] is not null)"
    row = f"named_struct('k', {KINDS.index(kind)}, 'i', i, 'gap', x['0'], 'size', x['1'], 'value', x['2'])"
    return f"CASE WHEN {text} rlike {p} THEN transform({zipped}, (x, i) -> {row}) END"


def _of(names: list, index: Column | str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def place_finds(lengths: DataFrame) -> DataFrame:
    """(row, k, s, e) of every match whose value is long enough; s and e are code points."""
    before = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lengths.where("k >= 0").withColumn("e", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    return placed.where(F.col("value") >= _of([PATTERNS[k][1] for k in KINDS], F.col("k"))).select("row", "k", (F.col("e") - F.col("size")).alias("s"), "e")


def link_parts(finds: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates among finds with a find of another role within reach and no base find over them."""
    role = _of(list(ROLES.values()), F.col("k"))
    bins = lambda lo, hi: F.explode(F.expr(f"sequence(cast(greatest(0, {lo}) div {reach} as int), cast(({hi}) div {reach} as int))")).alias("bin")
    weak = finds.where(F.col("k") >= len(BASE_KINDS)).select("row", "k", "s", "e", role.alias("role"), bins(f"s - {reach}", f"e + {reach}"))
    near = finds.select("row", F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("e").alias("e2"), role.alias("role2"), bins("s", "e"))
    pairs = weak.join(near, ["row", "bin"]).where(f"s2 - e <= {reach} and s - e2 <= {reach}")
    linked = F.bool_or(F.col("role") != F.col("role2"))
    covered = F.bool_or((F.col("k2") < len(BASE_KINDS)) & (F.col("s2") < F.col("e")) & (F.col("s") < F.col("e2")))
    return pairs.groupBy("row", "k", "s", "e").agg(linked.alias("linked"), covered.alias("covered")).where("linked and not covered").select("row", "k", "s", "e")


def scan_secrets(documents: DataFrame, *, reach: int = REACH) -> DataFrame:
    """Counts and digest of the base finds, and all finds as text and as an array of spans."""
    d = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    document = "array(named_struct('k', -1, 'i', 0, 'gap', 0, 'size', 0, 'value', 0))"  # stands for the document, so that none is lost
    found = ", ".join(f"coalesce({find_lengths('text', k)}, array())" for k in KINDS)
    lengths = materialize(d.select("doc_id", "row", F.inline(F.expr(f"concat({document}, {found})"))), "secrets")
    finds = place_finds(lengths)
    none = F.lit(None).cast("int")
    kept = (
        lengths.where("k < 0").select("row", "doc_id", none.alias("k"), none.alias("s"), none.alias("e"))
        .unionByName(finds.where(F.col("k") < len(BASE_KINDS)), allowMissingColumns=True)
        .unionByName(link_parts(finds, reach), allowMissingColumns=True)
    )
    spans = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("s", "k", "e")))).alias("kept")
    counts = [F.count_if(F.col("k") == i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    per = kept.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *counts, spans)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda a: f"array_join(transform({a}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')"
    return per.select(
        "doc_id",
        *[f"n_{k}" for k in BASE_KINDS],
        F.sha2(F.expr(joined(f"filter(kept, x -> x.k < {len(BASE_KINDS)})")), 256).alias("base_sha256"),
        F.expr(joined("kept")).alias("spans"),
        F.expr(f"transform(kept, x -> struct(get({names}, x.k) as kind, x.s as start, x.e as end))").alias("finds"),
    )
