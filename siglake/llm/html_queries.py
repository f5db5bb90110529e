"""Query op3_html_text. Parsing HTML has no SQL form; tests hold it against a brute-force version on a fixture."""

from siglake.llm.common import read
from siglake.llm.html import extract_text


def op3_html_text(spark, sf_dir):
    return extract_text(read(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLES = {}
