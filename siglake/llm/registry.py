"""All queries of this subpackage, and their SQL."""

from importlib import import_module

MODULES = ["rules_queries", "classifier_queries", "html_queries", "substrings_queries", "licenses_queries", "mixing_queries", "secrets_queries", "jaccard_queries", "pii_queries", "decontaminate_queries", "merkle_queries", "trie_queries", "vectors_queries"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"siglake.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
