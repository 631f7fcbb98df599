"""The pipeline's stages against brute force on their own inputs, and the registered queries against SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.llm import byte_bpe, mixing

from .test_operators import CLASH, WORD, brute_components, brute_lines, edge_rows

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs, names = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, FOLDER)
        if k < 4:
            assert out.columns == (names := names or docs.columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:  # good documents stay, bad ones go
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {i for i, _ in rows(docs)}
            for label, stays in ((1, True), (0, False)):
                own = [i for i, _ in before if labels.get(i) == label]
                assert len([i for i in own if (i in kept) == stays]) >= 0.95 * len(own) > 0
        elif k == 1:
            assert dict(rows(docs)) == {i: v[2] for i, v in brute_lines(before).items()}
        elif k == 2:
            want, links = brute_components(before)
            assert links
            assert {i for i, _ in rows(docs)} == {i for i, (_, c) in want.items() if i == c}
        elif k == 3:  # each source comes near its target, documents are taken at most twice
            taken = Counter(rows(docs))
            assert set(taken) <= set(before) and max(taken.values()) == 2
            planned = {r["source"]: r for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("longest")).collect()}
            words = Counter()
            for r in docs.collect():
                words[r["source"]] += len(WORD.findall(r["text"] or ""))
            assert all(abs(words[x] - r["target"]) <= r["longest"] + 1 for x, r in planned.items())
        else:
            path = pipeline.public_tokenizers.path(pipeline.TOKENIZER)
            got = byte_bpe.decode(docs, path).collect()
            assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == Counter((i, t or "") for i, t in before)
            assert all(r["n_tokens"] == len(r["ids"]) == len(r["offsets"]) for r in got)


def test_edges_of_every_stage(spark, tmp_path):
    """Null ids, texts, sources and languages, repeated rows, ties, a very long text and columns of clashing names go through; an empty table stays empty."""
    wide = [(*r, None, *[f"{k}-{j}" for j in range(len(CLASH))]) for k, r in enumerate(edge_rows())]
    table = spark.createDataFrame(wide, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = [(4, 1, 0), (5, 0, 0), (3, 1, 0), (None, 1, 0), (4, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (table, table.where("false")):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path)).collect()
            if docs is not table:
                assert out == []
                continue
            assert out or k == 0
            if k in (0, 2, 3):
                assert {str(r) for r in out} <= {str(r) for r in docs.collect()}
            if k == 1:
                assert len(out) == len(wide) and {r["n"] for r in out} == {r[4] for r in wide}
    got = {r["n"].split("-")[0] for r in pipeline.near_duplicates(spark, table, str(tmp_path)).collect()}
    assert got & {"2", "3", "4", "11"} and len(got & {"2", "3", "4", "11"}) == 1 and {"0", "1", "5", "6", "7", "8", "9", "10"} <= got
    once = pipeline.near_duplicates(spark, table.select("doc_id", "text", "source", "lang"), str(tmp_path)).collect()
    assert [r["doc_id"] for r in once].count(1) == 1


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_against_sql(spark, name):
    from tests.test_oracle import TABLES, plain

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, FOLDER).toPandas(), c.sql(__spark_entry__.oracle_sql()[name]).df()
    assert plain(got).equals(plain(want))


def test_one_row_of_each_near_duplicate_group_stays(spark):
    """Null ids, repeated rows, ids that several texts share, two groups with the same smallest id, wordless texts."""
    text = lambda k, edit="": " ".join(f"t{k}w{i}" for i in range(60)) + edit
    data = [
        (1, text(1)), (1, text(1)), (1, text(1)),  # repeated: one stays
        (None, text(2)), (None, text(2, " x")), (None, text(2)),  # null ids
        (None, text(3)), (9, text(3, " x")),  # a null id comes last
        (4, text(4)), (5, text(4, " x")), (5, text(5)),  # 5 is shared; its second text is clean
        (6, text(6)), (7, text(6, " x")), (6, text(7)), (8, text(7, " x")),  # two groups led by 6
        (10, text(8)), (10, text(8, " x")),  # near copies of one id
        (11, ""), (11, ""), (12, None), (None, text(9)),
    ]
    docs = spark.createDataFrame([(i, t, k % 2) for k, (i, t) in enumerate(data)], "doc_id long, text string, n long")
    docs = docs.withColumn("n", docs.n * 0)
    runs = [sorted(map(str, rows(pipeline.near_duplicates(spark, d, None)))) for d in (docs, docs.repartition(7, "text"))]
    assert runs[0] == runs[1]
    for got in runs:
        fixed = [(1, text(1)), (9, text(3, " x")), (4, text(4)), (5, text(5)), (6, text(6)), (6, text(7)), (11, ""), (11, ""), (12, None), (None, text(9))]
        assert all(got.count(str(r)) == fixed.count(r) for r in fixed)
        rest = [r for r in got if r not in map(str, fixed)]
        assert len(rest) == 2 and sum(r in map(str, data[3:5]) for r in rest) == 1 and sum(r in map(str, data[15:17]) for r in rest) == 1
