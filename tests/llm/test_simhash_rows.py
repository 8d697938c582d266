"""Near-dedup with texts that share an id and rows without one."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_component_stays(spark):
    from ledgerline.llm.simhash import keep_one_per_group
    rng = random.Random(3)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, d), (4, d), (5, c), (None, a), (None, e), (None, e)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], SCHEMA)
    for some in (docs, docs.orderBy("text"), docs.repartition(5, "text")):
        got = sorted(((r.doc_id or 0), r.text) for r in keep_one_per_group(some).collect())
        assert got == sorted([(1, a), (2, b), (4, c), (4, d), (0, e), (0, e)])
    assert keep_one_per_group(docs).columns == docs.columns
