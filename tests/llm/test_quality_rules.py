import math
from fractions import Fraction

import pyarrow as pa
from llm_support import ODD, prose, table, words_of

from cohortlab.llm import quality_rules, text_stats


def brute(text):
    text = text or ""
    w = words_of(text, lower=False)
    lines = [x for x in text.split("\n") if words_of(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {r for r in runs if runs.count(r) > 1}
    covered = {i + j for i, r in enumerate(runs) if r in twice for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(set(w))


TEXTS = [
    *[t for _, t in ODD], "a b c a b c d", "x y\nx y\n\n x y\nx y", "\n\nq\n \nq", "end\n", "#a *b $c |", "a a a a", "r s t u r s t", prose(4, 300), "l1 é\nl2\nl1 é\nL1 é",
    "same line here\n" * 40,
]


def test_counts_match_brute_force():
    got = text_stats.counts(pa.array(TEXTS))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")
    for i, text in enumerate(TEXTS):
        assert tuple(int(got[c][i]) for c in names) == brute(text), text


def test_binomial_tail_is_exact():
    for n, k, p in ((1, 0, 0.3), (20, 3, 0.1), (50, 0, 0.01), (50, 49, 0.5), (200, 30, 0.1), (7, 7, 0.2)):
        q = Fraction(p)
        want = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality_rules.binomial_tail(k, n, p), float(want), rel_tol=1e-9)


def test_cutoff_needs_evidence():
    ladder = [0.5, 0.3, 0.1]
    assert quality_rules.choose_cutoff(ladder, 10, [0, 0, 0], [5, 5, 5], 0.01, 0.001) is None
    assert quality_rules.choose_cutoff(ladder, 5000, [0, 0, 900], [5, 9, 30], 0.01, 0.001) == 0.3
    assert quality_rules.choose_cutoff(ladder, 5000, [0, 0, 0], [5, 9, 9], 0.01, 0.001) == 0.3
    assert quality_rules.choose_cutoff(ladder, 5000, [400, 0, 0], [5, 9, 9], 0.01, 0.001) is None
    assert quality_rules.choose_cutoff(ladder, 0, [0, 0, 0], [1, 1, 1], 0.01, 0.001) is None


def test_rules_reject_junk_in_strata_with_labels(spark):
    junk = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, prose(i, 60), "en") for i in range(900)] + [(1000 + i, junk + f" {i}", "en") for i in range(40)]
    rows += [(2000, junk, "fr"), (2001, prose(1, 49), "en"), (2002, "a b c " * 40, "en"), (2003, junk, None), (0, prose(0, 60), "en")]
    docs = table(spark, rows + ODD)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.risk_controlled(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(900))
    assert not any(by[1000 + i].kept for i in range(40)) and by[1039].rejected_by == ["symbol_share"]
    assert by[2000].kept and by[2003].kept  # no labels there, so nothing is certified
    assert by[2001].base_failed and by[2002].base_failed and not by[2002].kept
    assert by[90100].base_failed and by[90100].n_words == 0
    none = quality_rules.risk_controlled(docs, labels.where("false"))
    assert none.where("not base_failed and not kept").count() == 0
    assert quality_rules.risk_controlled(docs.where("false"), labels).count() == 0
