"""Shared fixture rows, and the rule that all operators take awkward tables."""

import pytest

from salesflow.llm import (
    chat_format, decontaminate, domain_score, exact_dedup, language_id, line_dedup, mixing, private_spans, simhash,
    token_files,
)
from salesflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, size long, target string, score double, key int, n int"
LONG = "word " * 400_000 + "end"
ROWS = [
    (1, "The cat sat on the mat today, again and again.", "en", "a", 1, "x", 0.5, 1, 1),
    (1, "The cat sat on the mat today, again and again.", "en", "a", 1, "x", 0.5, 1, 1),
    (2, None, None, None, None, None, None, None, None),
    (None, "a null id\nwith lines", "en", "b", 2, "y", 0.1, 2, 2),
    (3, "", "de", "b", 3, "z", 0.2, 3, 3),
    (4, " \n\t ", None, "c", 4, "z", 0.2, 3, 3),
    (5, "1234 &&& !!!", "en", None, 4, "z", 0.2, 3, 3),
    (6, LONG, "en", "a", 4, "z", 0.2, 3, 3),
    (7, "Über allen Gipfeln ist Ruh, \U0001F600 in allen Wipfeln", "de", "c", 4, "z", 0.2, 3, 3),
]
OPERATORS = {
    "decontaminate": lambda d: decontaminate.contaminated_pairs(d, d.selectExpr("doc_id AS item_id", "text")),
    "remove_contaminated": lambda d: decontaminate.remove_contaminated(d, d.selectExpr("doc_id AS item_id", "text")),
    "language": language_id.language_report,
    "keep_identified": language_id.keep_identified,
    "exact": exact_dedup.exact_groups,
    "tokens": lambda d: token_files.token_report(d, tokenizer_path()),
    "mixing": mixing.mixing_report,
    "mixture": mixing.mixture,
    "private": private_spans.private_report,
    "lines": line_dedup.line_digests,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "domain": lambda d: domain_score.score_words(d, d.select("doc_id").limit(2)),
    "chat": lambda d: chat_format.digests(chat_format.format_chats(
        d.selectExpr("doc_id AS conv_id", "n AS turn", "lang AS role", "text"))),
}
# Rows out of the nine rows in.
WANTED = {"language": 9, "exact": 9, "tokens": 9, "mixing": 9, "private": 9, "lines": 9, "simhash": 9, "domain": 9,
          "chat": 8}
SAME_COLUMNS = {"remove_contaminated", "keep_identified", "mixture", "keep_one"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = OPERATORS[name](docs)
    rows = out.collect()
    if name in WANTED:
        assert len(rows) == WANTED[name]
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](docs).collect() == []


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    languages = {(r.doc_id, r.lang_pred, r.score) for r in language_id.language_report(docs).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0)} <= languages
    exact = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert (exact[2].keep_id, exact[2].group_size, exact[4].kept, exact[3].kept) == (4, 3, True, False)
    assert exact[1].group_size == 2 and exact[1].kept and exact[None].keep_id is None
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[2].fingerprint == "0" * 16 and prints[3].component_id == prints[4].component_id == 2
    assert prints[None].component_id is None
    tokens = token_files.token_report(docs, tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in tokens] == [1, 1, 2, 3, 4, 5, 6, 7, None]
    assert [r.n_tokens for r in tokens if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    sizes = {r.doc_id: (r.size, r.taken) for r in mixing.mixing_report(docs).collect()}
    assert sizes[2] == (0, 0) and sizes[5][0] == 3
    scores = {r.doc_id: r for r in domain_score.score_words(docs, docs.select("doc_id").limit(2)).collect()}
    assert scores[2].n_tokens == 0 and scores[2].score is None and scores[6].n_tokens == 400_001
    lines = {r.doc_id: r for r in line_dedup.line_digests(docs).collect()}
    assert (lines[2].n_lines, lines[None].n_lines, lines[4].n_lines, lines[1].n_dropped) == (1, 2, 2, 0)
