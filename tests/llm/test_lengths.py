from llm_support import ODD, prose, table

from cohortlab.llm import lengths, tokens


def test_table_answers_every_limit(spark):
    rows = [(i, prose(i, i % 40)) for i in range(120)] + [(200 + i, "same words here") for i in range(50)] + [(300, prose(9, 3000)), *ODD]
    e = tokens.encoder(tokens.default_path())
    want = [len(e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    table_ = lengths.length_table(lengths.encoded_lengths(table(spark, rows)), width=16)
    got = {r.length: r for r in table_.collect()}
    assert set(got) == set(want)
    for n, r in got.items():
        assert r.n_docs == want.count(n) and r.docs_longer == sum(x > n for x in want) and r.tokens_up_to == sum(x for x in want if x <= n)
        assert r.truncated_total == sum(min(x, n) for x in want) and r.share_up_to == sum(x <= n for x in want) / len(want)
        assert r.next_length == min((x for x in want if x > n), default=None)
    limits = [0, 1, 2, 5, 17, 100, 5000, 10**6]
    for r in lengths.limit_totals(table_, limits).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in want), r
    for share in (0.01, 0.5, 0.999, 1.0):
        assert lengths.quantile_length(table_, share).first()[0] == sorted(want)[max(0, -(-int(share * 1000) * len(want) // 1000) - 1)]


def test_empty_table_and_limits_below_all_lengths(spark):
    empty = lengths.length_table(lengths.encoded_lengths(table(spark, [])))
    assert empty.count() == 0
    assert [tuple(r) for r in lengths.limit_totals(empty, [3]).collect()] == [(3, 0, 0, 0)]
    one = lengths.length_table(lengths.encoded_lengths(table(spark, [(1, prose(1, 20)), (2, prose(2, 20))])))
    assert lengths.limit_totals(one, [3]).first().truncated_total == 6
