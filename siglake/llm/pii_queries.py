"""Query op9_pii. The look-around of its patterns has no SQL form in DuckDB; tests check formats, check digits, permutations and links."""

from siglake.llm.common import read
from siglake.llm.pii import KINDS, pseudonymize

KEY = "siglake-demo-key"


def op9_pii(spark, sf_dir):
    return pseudonymize(read(spark, sf_dir, "documents"), key=KEY).select("doc_id", "text", *[f"n_{k}" for k in KINDS])


QUERIES = {"op9_pii": op9_pii}
ORACLES = {}
