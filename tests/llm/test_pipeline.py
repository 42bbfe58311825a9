"""The pipeline's stages one after the other, against what each must do to its own input."""

import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallyvox.llm import queries
from tallyvox.llm.quality import quality_scores

from .test_groups import grouped
from .test_models import base_spans

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, small, labels, path, tmp_path):
    docs, seen = small, [small]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:4]]
    assert all(d.columns == small.columns for d in seen[:4])
    good = {r.doc_id for r in quality_scores(small, labels).where("predicted = 1").collect()}
    assert texts[1] == {k: t for k, t in texts[0].items() if k in good}
    groups = grouped(texts[1].items(), 80)
    assert texts[2] == {k: t for k, t in texts[1].items() if groups[k] == k}
    assert texts[3].keys() == texts[2].keys() and not any(base_spans(t) for t in texts[3].values() if t)
    assert all(texts[3][k] == t for k, t in texts[2].items() if not base_spans(t) and "[" not in texts[3][k])
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = seen[4].orderBy("doc_id", "start").collect()
    for k, t in texts[3].items():
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        mine = [r for r in pieces if r.doc_id == k]
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)


def test_stages_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() >= 0


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_fingerprints_match_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, FOLDER)
        cursor = con.execute(sql)
        at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
        want = [tuple(r[i] for i in at) for r in cursor.fetchall()]
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
