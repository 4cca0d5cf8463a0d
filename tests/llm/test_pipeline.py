import pytest

import corpus_pipeline

from .conftest import words


def docs(spark):
    base = words(1, 120)
    bench = words(2, 30)
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base[:60] + ["edit"] + base[61:])),
        (3, " ".join(words(3, 40) + bench + words(4, 40))),
        (4, "l one\nl two\nl three\nown text " + " ".join(words(5, 30))),
        (5, "l one\nl two\nl three\nother text " + " ".join(words(6, 30))),
        (6, " ".join(words(7, 50))),
        (7, None),
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), " ".join(bench)


@pytest.fixture
def folder(spark, tmp_path):
    d, bench = docs(spark)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    columns = d.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert d.columns == columns
        seen.append(sorted(r.doc_id for r in d.collect()))
    assert seen == [[1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7], [1, 3, 4, 5, 6, 7], [1, 4, 5, 6, 7]]
    text = {r.doc_id: (r.text, r.n_chars) for r in d.collect()}
    assert text[5][0].startswith("other text") and text[5][1] == len(text[5][0]) and text[4][0].startswith("l one")
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {1, 4, 5, 6, 7}


def stages(spark, df, folder):
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        out.append(df)
    return out


def test_edge_rows(spark, folder, edge, nothing, edge_rows):
    """Null and repeated doc_ids, an empty table, clashing columns, no n_chars, a very long text."""
    clash = edge.selectExpr("*", "'g' as gone", "1 as n_lines", "2 as row0", "'k' as kept").drop("n_chars")
    last = stages(spark, clash, folder)[-1]
    assert last.columns == clash.columns
    rows = last.collect()
    ids = [r.doc_id for r in rows]
    assert None in ids and ids.count(3) == 1 and {0, 1, 2, 4, 5}.issubset(ids) and 6 not in ids and 7 not in ids
    assert all((r.rep, r.gone, r.n_lines, r.row0, r.kept) == (1, "g", 1, 2, "k") for r in rows if r.doc_id is not None)
    assert next(r.text for r in rows if r.doc_id == 4) == edge_rows[4][1]
    assert [x.count() for x in stages(spark, nothing, folder)] == [0, 0, 0, 0]
    assert corpus_pipeline.pack(spark, nothing, folder).count() == 0


def test_rows_of_one_doc_id_go_by_their_own_text(spark, folder):
    one, two = " ".join(words(21, 80)), " ".join(words(22, 80))
    d = spark.createDataFrame([(1, one), (2, two), (2, one), (3, two), (None, one)], "doc_id long, text string")
    left = corpus_pipeline.drop_near(spark, d, folder)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, one), (1, one), (2, two)])
