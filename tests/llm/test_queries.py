"""The registered queries against DuckDB, and the pipeline against a plain version of its stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.llm import catalog
from larder.llm import op06_language_id as lang
from larder.llm import op10_toxicity as tox

from .test_operators import brute_components, brute_groups, check_packing

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(name, spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    theirs = c.sql(catalog.SQL[name])
    at = [theirs.columns.index(x) for x in columns]
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in entry.queries() if k[:2] == "op"} and "pipeline" in entry.queries()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    clean = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if clean.score(r.text) < cp.TOXIC]
    told = lang.fit(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if told.predict(r.text)[0] != "und" and told.predict(r.text)[1] >= cp.TOLD]
    keep = brute_groups([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if keep[r.doc_id][0] == r.doc_id]
    component = brute_components([(r.doc_id, r.text) for r in rows], cp.NEAR)
    want = {r.doc_id for r in rows if component[r.doc_id][1] == r.doc_id}
    got = cp.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == want
    check_packing(got, 4096)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, no rows, and columns named like the stages' own."""
    import corpus_pipeline as cp

    words = "the cat sat on the mat with a hat and the dog ran to the house by the river".split()
    long = " ".join(words * 3000)
    rows = [(1, " ".join(words), "en"), (1, " ".join(words), "en"), (2, " ".join(words) + " ", None), (3, None, "en"), (4, "", None), (5, "12 !", "en"), (6, long, "en"), (None, "the cat and the dog ran", "en"), (7, " ".join(words + ["today"]), "xx")]
    names = ["toxic_score", "lang_told", "lang_share", "_toxic", "_lang", "_told", "file", "row", "doc", "text_", "bands", "kept"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in names})
    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = lambda df: sorted((r.doc_id or -1) for r in df.collect())
    after = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", *names] and docs.filter(" or ".join(f"{c} <> '{c}'" for c in names)).count() == 0
        after[name] = ids(docs)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert after["toxicity"] == [-1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert after["language"] == [-1, 1, 1, 2, 6, 7] and {r.lang for r in docs.collect()} == {"en"}
    assert after["exact_dedup"] == [-1, 2, 6, 7]
    assert after["near_dedup"] == [-1, 2, 6]
    assert check_packing(cp.packed(spark, docs, str(tmp_path)).collect(), 4096) > 0 and cp.packed(spark, docs.limit(0), str(tmp_path)).count() == 0
