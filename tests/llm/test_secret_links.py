"""Credential links of texts with very many finds against a plain loop over all pairs of near finds."""

import re
import time

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.secrets import KINDS, PATTERNS, REACH, ROLES, scan_secrets  # noqa: E402


def plain(text: str) -> str:
    finds = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind][0], text) if len(m.group(1)) >= PATTERNS[kind][1])
    role = [ROLES[k] for k in KINDS]
    out = []
    for s, k, e in finds:
        near = [g for g in finds if g[0] - e <= REACH and s - g[2] <= REACH] if k >= 3 else []
        if k < 3 or (any(role[g[1]] != role[k] for g in near) and not any(g[1] < 3 and g[0] < e and s < g[2] for g in near)):
            out.append(f"{KINDS[k]}:{s}:{e}")
    return ",".join(out)


def test_links_against_all_pairs(spark):
    far = " x" * REACH
    texts = [
        "user_id=bob" + far[: REACH - 1] + "pwd=abcd", "user_id=bob" + far + "pwd=abcd", "pwd=abcd alone", "user_id=bob user_id=eve",
        "http://h.example/" + "a" * 3 * REACH + " pwd=abcd and login: joe", "credential=password=abcdefgh user_id=bob", "🙂 é login=joe 10.0.0.1 auth: zzzz " * 40, "pwd=abcd" + far + "10.0.0.1" + far + "login=joe token=abcdef",
    ]
    rows = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    assert sorted(r.spans for r in scan_secrets(rows).collect()) == sorted(plain(t) for t in texts * 2)


def test_cost_grows_with_the_finds(spark):
    piece = "login=joe7 pwd=abcd 10.0.0.1 " + "y" * 220 + " pwd=lone " + "z" * 220 + " "
    took = {}
    for n in (2_500, 25_000, 25_000):  # 100,000 finds in the largest text
        started = time.monotonic()
        row = scan_secrets(spark.createDataFrame([(1, piece * n)], "doc_id long, text string")).first()
        took[n] = time.monotonic() - started
        assert len(row.finds) == 3 * n and row.spans.startswith(plain(piece) + ",")
    assert took[25_000] < 60
