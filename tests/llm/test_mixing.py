import math

from tallyfold.llm.mixing import mix, mixture, targets

DOCS = "doc_id long, text string, source string, rate string"


def plain(sizes, weights, share, most):
    """Shares by weight; what is above its limit is fixed there and the rest shared anew."""
    open_ = dict(zip(sizes, weights, strict=True))
    left, done = share * sum(sizes.values()), {}
    while open_:
        level = left / sum(open_.values())
        above = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not above:
            return done | {s: level * w for s, w in open_.items()}
        for s in above:
            done[s] = most * sizes[s]
            left -= done[s]
            del open_[s]
    return done


def test_targets(spark):
    for values in ((100, 50, 10), (5, 500, 5, 5), (10, 10, 10, 10, 10, 10, 10), (0, 3), (0, 0), (1,), (7, 1, 90, 3, 300, 2)):
        sizes = {f"s{i}": v for i, v in enumerate(values)}
        found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        wanted = plain(sizes, [(5, 2, 1)[i % 3] for i in range(len(values))], 1.5, 2)
        assert all(math.isclose(r.target, wanted[r.source], abs_tol=1e-9) for r in found), values
        assert math.isclose(sum(r.target for r in found), 1.5 * sum(values))


def corpus(spark):
    return spark.range(3000).selectExpr("id AS doc_id", "trim(repeat('w ', CAST(1 + id % 9 AS INT))) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE CAST(id % 7 AS STRING) END AS source", "'x' AS rate")


def test_taken_is_near_the_target(spark):
    found = mixture(corpus(spark)).collect()
    assert len(found) == 3000 and all(r.taken in (r.size * math.floor(r.target / r.source_size), r.size * math.ceil(r.target / r.source_size)) and r.taken <= 2 * r.size for r in found)
    by = {}
    for r in found:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - w) <= 0.05 * w for t, w in by.values())
    assert sorted(map(str, found)) == sorted(map(str, mixture(corpus(spark).repartition(9)).collect()))


def test_mix_repeats_whole_rows(spark):
    docs = corpus(spark)
    copies = {r.doc_id: r.copies for r in mixture(docs).collect()}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}
    assert mixed.intersect(docs).count() == docs.join(mixed.select("doc_id").distinct(), "doc_id").count()


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, None, None, "r"), (1, "", "a", "r"), (2, "a\tb\x0bc é\u00a0d", "a", "r"), (2, "a\tb\x0bc é\u00a0d", "a", "r"), (3, "w " * 50_000, "b", "r")]
    found = sorted(((r.doc_id, r.size) for r in mixture(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert found == [(1, 0), (2, 4), (2, 4), (3, 50_000), (None, 0)]
    empty = spark.createDataFrame([], DOCS)
    assert mixture(empty).count() == 0 and mix(empty).count() == 0
