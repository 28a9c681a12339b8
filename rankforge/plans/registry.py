"""Experiments: named plans over the operators, with parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.text import LEGAL, LEMMA, PHRASE, PLAIN, number_label
from ..operators.chunking import ChunkRules
from ..operators.ranking import AGGREGATIONS
from ..operators.retrieval import BM25, TfIdf

KINDS = ("tfidf_doc", "bm25_doc", "bm25_field_doc", "bm25_chunk", "dense_chunk", "bge_m3_chunk", "rrf", "quota_rrf")
#: Short names of chunk aggregations in experiment names (fixed values).
AGGREGATION_LABELS = dict(zip(AGGREGATIONS, ("max", "top2", "max2", "softmax3"), strict=True))


@dataclass(frozen=True)
class Experiment:
    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    priority: str = "P0"
    description: str = ""

    @property
    def members(self) -> tuple[str, ...]:
        return tuple(self.params.get("members", ()))

    @property
    def rank_depth(self) -> int:
        return int(self.params.get("rank_depth") or 50)


LINE_10_5 = ChunkRules("line", 10, 5)
CHAR_TFIDF = TfIdf("char_wb", (3, 5), min_df=1)


def _doc(name, rules=PLAIN, priority="P0", kind="bm25_doc", **grid) -> Experiment:
    return Experiment(name, kind, {"config": BM25(rules=rules, **grid)}, priority)


def _chunk(name, rules=LEGAL, chunk=LINE_10_5, aggregation="max", rank_depth=600, priority="P0", **grid) -> Experiment:
    return Experiment(name, "bm25_chunk", {"config": BM25(rules=rules, **grid), "chunk": chunk, "aggregation": aggregation, "rank_depth": rank_depth}, priority)


def _tfidf(name, config, priority="P1") -> Experiment:
    return Experiment(name, "tfidf_doc", {"config": config}, priority)


def _rrf(name, *members, priority="P1") -> Experiment:
    return Experiment(name, "rrf", {"members": list(members), "rrf_k": 60, "rank_depth": 100}, priority)


def _quota(name, quota, *members, priority="P0") -> Experiment:
    return Experiment(name, "quota_rrf", {"members": list(members), "quota": quota, "rrf_k": 60, "rank_depth": 100, "member_rank_depth": 100}, priority)


def _model_chunk(name, kind, config, chunk=LINE_10_5, rank_depth=600, priority="P1") -> Experiment:
    return Experiment(name, kind, {"config": config, "chunk": chunk, "aggregation": "max", "rank_depth": rank_depth}, priority)


E5 = {"model_name": "intfloat/multilingual-e5-base", "batch_size": 32, "query_prefix": "query: ", "passage_prefix": "passage: "}
M3_DENSE = {"model_name": "BAAI/bge-m3", "batch_size": 8, "query_prefix": "", "passage_prefix": "", "max_seq_length": 2048}
M3_BOTH = {"batch_size": 4, "max_length": 2048, "use_sparse": True, "dense_weight": 0.7, "sparse_weight": 0.3}


def default_experiments(include_optional: bool = False) -> list[Experiment]:
    doc, chunk = "bm25_doc", "bm25_chunk_line_10_5_max"
    legal_doc, legal_chunk = "bm25_legal_lemma_doc", "bm25_legal_lemma_chunk_line_10_5_max"
    phrase_doc, phrase_chunk = "bm25_legal_phrase_doc", "bm25_legal_phrase_chunk_line_10_5_max"
    char = "tfidf_char_doc_3_5"
    out = [
        _tfidf("tfidf_word_doc", TfIdf(), "P0"),
        _tfidf(char, CHAR_TFIDF),
        _tfidf("tfidf_word_lemma_doc", TfIdf(rules=LEMMA)),
        _tfidf("tfidf_word_legal_lemma_doc", TfIdf(rules=LEGAL)),
        _doc(doc),
        _doc("bm25_lemma_doc", LEMMA),
        _doc(legal_doc, LEGAL),
        _doc(phrase_doc, PHRASE, "P1"),
        _doc("bm25_field_aware_doc", kind="bm25_field_doc", priority="P1"),
        _doc("bm25_legal_lemma_field_doc", LEGAL, "P1", "bm25_field_doc"),
        _chunk(chunk, PLAIN, rank_depth=120),
        _chunk(legal_chunk, rank_depth=120),
        _chunk(phrase_chunk, PHRASE, rank_depth=120, priority="P1"),
        _chunk("bm25_chunk_line_8_4_top2", PLAIN, ChunkRules("line", 8, 4), "top2_mean", 120),
        _rrf("rrf_bm25_doc_chunk", doc, chunk, priority="P0"),
        _rrf("rrf_legal_lemma_doc_chunk", legal_doc, legal_chunk, priority="P0"),
        _rrf("rrf_legal_phrase_doc_chunk", phrase_doc, phrase_chunk),
        _rrf("rrf_sparse_doc_chunk_char", doc, chunk, char),
        _rrf("rrf_sparse_legal_lemma_char", legal_doc, legal_chunk, char, priority="P0"),
        _rrf("rrf_sparse_legal_lemma_word_char", legal_doc, legal_chunk, "tfidf_word_legal_lemma_doc", char),
        _rrf("rrf_sparse_doc_chunk_char_field", doc, chunk, char, "bm25_field_aware_doc"),
    ]
    if include_optional:
        out += [_model_chunk("dense_e5_chunk_line_10_5", "dense_chunk", E5, rank_depth=120, priority="P2"), _rrf("rrf_bm25_dense", doc, chunk, "dense_e5_chunk_line_10_5", priority="P2")]
    return out


def recall_experiments(include_optional: bool = False, include_bge_m3: bool = False) -> list[Experiment]:
    """Candidate generators for recall at 20 and 50: deeper chunk rankings, other chunks, parameter grids, wider fusion."""
    name = "bm25_legal_lemma_chunk_{}_rd600".format
    out = [_chunk(f"bm25_legal_lemma_chunk_line_10_5_max_rd{d}", rank_depth=d) for d in (300, 600, 1000)]
    views = [ChunkRules("line", n, n // 2) for n in (6, 8, 12, 16)] + [ChunkRules("char", n, n // 2) for n in (1200, 1600, 2000)] + [ChunkRules("paragraph", 1, 0), ChunkRules("paragraph", 2, 1)]
    for view in views:
        for how in AGGREGATIONS:
            out.append(_chunk(name(f"{view.label}_{AGGREGATION_LABELS[how]}"), chunk=view, aggregation=how, priority="P0" if view.unit == "line" and how == "max" else "P1"))
    for k1 in (1.2, 1.5, 1.8):
        out += [_doc(f"bm25_legal_lemma_doc_k1{number_label(k1)}_b{number_label(b)}", LEGAL, "P1", k1=k1, b=b) for b in (0.5, 0.75, 0.9) if (k1, b) != (1.5, 0.75)]
    for k1 in (0.9, 1.2, 1.5):
        out += [_chunk(name(f"line_10_5_k1{number_label(k1)}_b{number_label(b)}"), priority="P1", k1=k1, b=b) for b in (0.2, 0.5, 0.75) if (k1, b) != (1.5, 0.75)]
    doc, line, char = "bm25_legal_lemma_doc", name("line_10_5_max"), "tfidf_char_doc_3_5"
    many = (doc, *(name(f"{v}_max") for v in ("line_6_3", "line_10_5", "line_16_8", "char_1600_800", "paragraph_2_1")), char)
    out += [
        _rrf("rrf_sparse_deep_legal_lemma_char", doc, line, char, priority="P0"),
        _rrf("rrf_sparse_multichunk_legal_char", *many, priority="P0"),
        _quota("quota_sparse_legal_lemma_char_q5", 5, doc, line, char),
        _quota("quota_sparse_legal_lemma_char_q10", 10, doc, line, char),
        _quota("quota_sparse_multichunk_q8", 8, *many),
    ]
    wide = ChunkRules("char", 1600, 800)
    if include_optional:
        e5 = "dense_e5_chunk_line_10_5_rd600"
        out += [
            _model_chunk(e5, "dense_chunk", E5),
            _model_chunk("dense_e5_chunk_char_1600_800_rd600", "dense_chunk", E5, wide),
            _rrf("rrf_sparse_e5_line", doc, line, char, e5),
            _quota("quota_sparse_e5_line_q8", 8, doc, line, char, e5, priority="P1"),
        ]
    if include_bge_m3:
        m3, both = "dense_bge_m3_chunk_line_10_5_rd600", "bge_m3_dense_sparse_chunk_line_10_5_rd600"
        out += [
            _model_chunk(m3, "dense_chunk", M3_DENSE),
            _model_chunk(both, "bge_m3_chunk", M3_BOTH),
            _model_chunk("bge_m3_dense_sparse_chunk_char_1600_800_rd600", "bge_m3_chunk", M3_BOTH, wide, priority="P2"),
            _rrf("rrf_sparse_bge_m3_line", doc, line, char, m3),
            _rrf("rrf_sparse_bge_m3_native_line", doc, line, char, both),
            _quota("quota_sparse_bge_m3_native_line_q8", 8, doc, line, char, both, priority="P1"),
        ]
    return merged(out)


def merged(*lists: list[Experiment] | None) -> list[Experiment]:
    """All experiments by name, the first of a name wins."""
    by_name: dict[str, Experiment] = {}
    for e in (e for part in lists for e in part or ()):
        by_name.setdefault(e.name, e)
    return list(by_name.values())


def checked(experiments: list[Experiment]) -> dict[str, Experiment]:
    """By name; ValueError for unknown kinds and members and for members that lead back to their experiment."""
    by_name = {e.name: e for e in experiments}
    for e in experiments:
        if e.kind not in KINDS:
            raise ValueError(f"unknown kind of {e.name}: {e.kind}")
        unknown = [m for m in e.members if m not in by_name]
        if unknown:
            raise ValueError(f"unknown members of {e.name}: {unknown}")
    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("experiments go round in a circle: " + " > ".join((*path, name)))
        if name not in done:
            for m in by_name[name].members:
                visit(m, (*path, name))
            done.add(name)

    for e in experiments:
        visit(e.name, ())
    return by_name


def selected(experiments: list[Experiment], names: list[str] | None) -> list[Experiment]:
    if not names:
        return experiments
    unknown = sorted(set(names) - {e.name for e in experiments})
    if unknown:
        raise ValueError(f"unknown experiments: {unknown}")
    return [e for e in experiments if e.name in set(names)]
