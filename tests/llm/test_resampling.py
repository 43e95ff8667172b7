import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from moundworks.llm import resampling


@given(st.binary(max_size=2000), st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 2000)), max_size=8))
def test_crc_of_any_substring(data, ranges):
    at = np.minimum(np.array(ranges or [(0, 0)]), len(data))
    low, high = at.min(axis=1), at.max(axis=1)
    found = resampling.substring_crcs(resampling.running_crcs(np.frombuffer(data, np.uint8)), low, high)
    assert found.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(low, high)]


def features(text, words):
    w = brute.small_words(text)
    return [" ".join(w[i:i + n]) for n in range(1, words + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("words", [1, 3])
def test_buckets_of_ngrams(words):
    texts = ["One two, THREE two", None, "", " \t", "Ünï cödé ñandú 你好 😀", "x" * 3000 + " y", "a", "b c " * 400]
    cell, n, n_words = resampling.ngram_buckets(pa.array(texts), words)
    want = [[zlib.crc32(x.encode()) % 10_000 for x in features(t, words)] for t in texts]
    assert n.tolist() == [len(x) for x in want] and n_words.tolist() == [len(features(t, 1)) for t in texts]
    assert cell.tolist() == [b for x in want for b in x]


def plain(docs, target, words=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def count(rows):
        return Counter(zlib.crc32(x.encode()) % buckets for r in rows for x in features(r.text, words))

    raw, aim = count(docs), count(target)
    n_raw, n_aim = raw.total(), aim.total()
    out = []
    for r in docs:
        f = [zlib.crc32(x.encode()) % buckets for x in features(r.text, words)]
        gain = [math.floor(1000 * math.log((aim[b] + 1) * (n_raw + buckets) / ((raw[b] + 1) * (n_aim + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(features(r.text, 1))])
    enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = place + 1
    return sorted(repr(tuple(r[:5])) for r in out)


def found(docs, target, **how):
    rows = resampling.resampled(docs, target, **how).collect()
    assert [*rows[0].asDict()] == ["doc_id", "n_features", "weight", "score", "rank"] if rows else True
    return sorted(repr(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def target(spark):
    from conftest import DATA
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


def test_documents(docs, target):
    assert found(docs, target) == plain(docs.collect(), target.collect())


def test_longer_runs_and_other_parameters(docs, target):
    how = dict(words=2, buckets=97, min_words=5, percent=33, seed=7)
    assert found(docs, target, **how) == plain(docs.collect(), target.collect(), **how)


def test_odd_rows_repeats_and_empty_tables(odd, none, target, spark):
    for rows, aim in ((odd, target), (odd.union(odd), target), (odd, target.limit(0)), (odd, target.selectExpr("CAST(null AS string) AS text", "1 AS n"))):
        assert found(rows, aim, min_words=3, percent=50) == plain(rows.collect(), aim.collect(), min_words=3, percent=50)
    assert found(none, target) == []
    ties = spark.createDataFrame([(7, "same words here", k) for k in range(40)], "doc_id bigint, text string, n_words int")
    ranks = sorted(r.rank or 0 for r in resampling.resampled(ties, target, min_words=1).collect())
    assert ranks == [0] * 36 + [1, 2, 3, 4]
