"""Query op2_classifier. A trained model has no SQL form; tests hold it to accuracy on labels it has not seen."""

from siglake.llm.classifier import score
from siglake.llm.common import read

TRAIN_DOCS, LEXICON_DOCS = 20_000, 20_000


def op2_classifier(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), train_docs=TRAIN_DOCS, lexicon_docs=LEXICON_DOCS)


QUERIES = {"op2_classifier": op2_classifier}
ORACLES = {}
