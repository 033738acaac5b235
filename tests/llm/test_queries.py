"""The registered queries on the smallest tables: SQL twins where there are some, and what the contracts say of the columns."""

import hashlib
import struct

import duckdb
import pandas as pd
import pytest

import public_tokenizers
from leafmill.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    show = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_twin(spark, db, name):
    found, want = Q.QUERIES[name](spark, SF).toPandas(), db.sql(Q.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_names():
    assert sorted(Q.QUERIES, key=lambda x: int(x[2:].split("_")[0])) == [*Q.QUERIES]
    assert len(Q.QUERIES) == 13 and set(Q.ORACLES) < set(Q.QUERIES)


def test_op1_columns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = Q.QUERIES["op1_secret_scan"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        spans = [x for x in r.spans.split(",") if x]
        base = [x for x in spans if not x.startswith("guess")]
        assert r.n_assign + r.n_access + r.n_hex == len(base) and len(spans) == len(base) + r.n_guess
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert all(0 <= int(x.split(":")[1]) < int(x.split(":")[2]) <= len(texts[r.doc_id]) for x in spans)


def test_op6_digests(spark):
    import tiktoken

    from leafmill.llm.byte_bpe import load_ranks

    judge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = Q.QUERIES["op6_byte_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = judge.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op9_rows(spark):
    from zlib import crc32

    found = Q.QUERIES["op9_quality_classifier"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op12_pieces(spark):
    from zlib import crc32

    from tokenizers import Tokenizer

    judge = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found, want = Q.QUERIES["op12_best_fit_packing"](spark, SF).collect(), []
    for r in docs:
        ids = [*judge.encode(r.text or "", add_special_tokens=False).ids, 0]
        starts = [0] if len(ids) <= 2048 else [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((r.doc_id, k, a, b - a, crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    total = sum(r.length for r in found)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 2048
    assert len(by) <= -(-total // 2048) + 1
