import re

import pytest

from rankforge.operators.chunking import ChunkRules, chunks

#: What a paragraph is (fixed value).
PARAGRAPH = re.compile(r"\S(?:.*?\S)?(?=\n\s*\n|$)", re.DOTALL)


def reference(doc, text, r):
    if r.unit == "char":
        out, start, n = [], 0, 0
        while True:
            end = min(len(text), start + r.size)
            if text[start:end].strip():
                out.append((n, start, end, text[start:end].strip()))
            if end >= len(text):
                break
            start, n = start + r.step, n + 1
        return out or [(0, 0, len(text), text)]
    if r.unit == "line":
        spans, at = [], 0
        for line in text.splitlines(keepends=True):
            if line.strip():
                spans.append((at, at + len(line)))
            at += len(line)
    else:
        spans = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)]
    if not spans:
        return [(0, 0, len(text), text)]
    out, left = [], 0
    while True:
        right = min(len(spans), left + r.size)
        s, e = spans[left][0], spans[right - 1][1]
        out.append((len(out), s, e, text[s:e].strip()))
        if right == len(spans):
            return out
        left += r.step


TEXTS = ["", "   \n ", "one line", "a\n\nb\n c \n\n\nd", "x\r\ny\rz\n", "\n".join(f"line {i}" for i in range(23)), "p one\nstill one\n\n \np two\n\np three  \n", "a  \n\nb\n", "a\n\nb\n\n  ", " \n\n x\n\ny"]


@pytest.mark.parametrize("rules", [ChunkRules("line", 3, 1), ChunkRules("line", 10, 5), ChunkRules("char", 7, 3), ChunkRules("char", 5, 0), ChunkRules("paragraph", 2, 1)], ids=lambda r: r.label)
def test_chunks(spark, rules):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {}
    for r in chunks(rows, rules).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.start, r.end, r.text))
        assert r.chunk_id == f"{r.doc_id}::{rules.unit}::{r.position}"
    for i, t in enumerate(TEXTS):
        assert sorted(got[i]) == reference(i, t, rules), (i, t)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        ChunkRules("word")
    with pytest.raises(ValueError):
        ChunkRules("line", 0)
