import corpus_pipeline
import duckdb
import pytest
from test_operators import base_spans, linked

from loomspan.llm.pieces import Pieces
from loomspan.llm.queries import ORACLE_SQL, QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    keep = {i for i, (_, c) in linked([(i, r["text"]) for i, r in before.items()]).items() if i == c}
    gone = keep - set(out)
    assert set(out) <= keep and len(gone) <= 1  # only what has no language may go besides copies
    model = Pieces(open(tokenizer(), "rb").read())
    for i, r in out.items():
        assert not base_spans(r["text"])
        assert r["text"] == before[i]["text"] or base_spans(before[i]["text"]) or "[SECRET]" in r["text"]
        assert r["n_chars"] == len(r["text"]) and r["ids"] == model.encode(r["text"]).tolist()


def test_the_mix_is_returned(spark, tmp_path, monkeypatch):
    """Over prefixes of what run() returns, in order, each source is within a block of its share."""
    sizes = {"a": 180, "b": 60, "c": 20}
    rows = [(100 * n + i, "word " * 3000, s) for s, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "slot").collect(), key=lambda r: (r["slot"], r["doc_id"]))
    assert [r["doc_id"] for r in got] != sorted(r["doc_id"] for r in got) and len(got) == len(rows)
    blocks = {s: 15001 * (n - 1) // 65536 + 1 for s, n in sizes.items()}
    weight, had = {s: n**0.7 for s, n in blocks.items()}, dict.fromkeys(sizes, 0)
    for slot in sorted({r["slot"] for r in got}):
        had[next(r["source"] for r in got if r["slot"] == slot)] += 1
        assert all(abs(had[s] - (slot + 1) * w / sum(weight.values())) < 1 + 1e-9 for s, w in weight.items())
        if any(had[s] + 1 >= blocks[s] for s in sizes):
            break
    assert sum(had.values()) >= 10


def test_stages_on_odd_rows(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert docs.columns[: len(rows.columns)] == rows.columns
        docs.collect()


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)
