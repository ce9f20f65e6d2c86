"""Tokens of two vocabularies over the same bytes, against a walk over both lists of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from likegraph.llm import alignment, queries
from likegraph.workers import let_workers_import
from tests.llm.test_llm import SCHEMA, some_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Alphabet of odd texts: white space of all kinds, special tokens' strings, the model's own mark for a space.
ODD = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "漢", "🙂", "1", "23", ".", "'s", "<|endoftext|>", "<s>", "▁", "　", "\x00", "\xa0", "Ａ", "ﬁ", "\x1c", "é", "\r\n"]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(A, B)


def tokens(own, text):
    """Both vocabularies' tokens as (id, start, stop) over space+text; none where bytes differ."""
    out = []
    whole = (" " + text).encode() if text else b""
    for ids, table in ((own.tokenizer.encode(" " + text, add_special_tokens=False).ids, own.bytes["a"]), (own.pieces.encode(text), own.bytes["b"])) if text else ():
        if b"".join(table[i] for i in ids) != whole:
            return [], []
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        out.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    return out or ([], [])


def walk(own, text):
    """n_a, n_b, groups as (start, stop, ids, ids), links as (id, id)."""
    a, b = tokens(own, text)
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [(s, e, [i for i, x, y in a if s <= x and y <= e], [i for i, x, y in b if s <= x and y <= e]) for s, e in zip([0, *cuts], cuts, strict=False)]
    return len(a), len(b), groups, [(i, j) for i, _, x in a for j, _, y in b if x == y]


def test_odd_texts(own):
    r = random.Random(5)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(600)]
    for text, (n_a, n_b, n_groups, said, codes) in zip(texts, own.align(texts), strict=True):
        x, y, groups, links = walk(own, text)
        assert (n_a, n_b, n_groups) == (x, y, len(groups)), text
        assert said == ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        assert [divmod(c, own.width) for c in codes.tolist()] == links


def test_a_full_store_forgets_and_learns_again(own, monkeypatch):
    texts = [t for _, t, *_ in some_docs(9, 30) if t]
    want = [(x[:4], x[4].tolist()) for x in own.align(texts)]
    monkeypatch.setattr(alignment, "MOST_CHUNKS", 20)
    monkeypatch.setattr(alignment, "RUN", 50)
    assert [(x[:4], x[4].tolist()) for t in texts for x in own.align([t])] == want


@pytest.fixture(scope="module")
def rows():
    return [*some_docs(3, 30), (900, "a <|endoftext|> b <s> c", None, None, None), (901, "a▁b", None, None, None), (902, "x" * 30_000, None, None, None), (903, "ab " * 60_000, None, None, None)]


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 0])
def test_query_by_hand(spark, own, rows, tmp_path, monkeypatch, most):
    """With counts broadcast and with counts joined; extra columns of the operator's own names."""
    let_workers_import(spark)
    spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "code": F.lit(2), "_row": F.lit(3)}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(alignment.align, "__defaults__", ("doc_id", "text", most))
    walked = [walk(own, t) if t and len(t) < 20_000 else None for _, t, *_ in rows]
    long = {t: list(own.align([t]))[0] for _, t, *_ in rows if t and len(t) >= 20_000}
    counts = Counter(p for w in walked if w for p in w[3]) + Counter(divmod(c, own.width) for _, t, *_ in rows if t in long for c in long[t][4].tolist())
    most_of = {}
    for (_, b), n in counts.items():
        most_of[b] = max(most_of.get(b, 0), n)
    want = []
    for (i, t, *_), w in zip(rows, walked, strict=True):
        if t in long:
            n_a, n_b, _, said, codes = long[t]
            links = [divmod(c, own.width) for c in codes.tolist()]
        else:
            n_a, n_b, groups, links = w or (0, 0, [], [])
            said = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        want.append((i, n_a, n_b, len(said.split(";")) if said else 0, len(links), sum(counts[p] == most_of[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    key = lambda t: (t[0] is None, *map(str, t))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_groups_and_overlaps(spark, own, rows):
    few = [r for r in rows if r[1] is None or len(r[1]) < 300]
    docs = spark.createDataFrame(few, SCHEMA).filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups, shared = {}, {}
    for r in alignment.token_groups(docs, A, B).collect():
        groups.setdefault(r["doc_id"], []).append((r["number"], r["start"], r["stop"], r["a"], r["b"]))
    for r in alignment.token_overlaps(docs, A, B).collect():
        shared.setdefault(r["doc_id"], set()).add((r["a"], r["b"], r["bytes"]))
    for i, t in texts.items():
        assert [g[1:] for g in sorted(groups.get(i, []))] == walk(own, t or "")[2]
        a, b = tokens(own, t or "")
        assert shared.get(i, set()) == {(p, q, min(y, v) - max(x, u)) for p, (_, x, y) in enumerate(a) for q, (_, u, v) in enumerate(b) if min(y, v) > max(x, u)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.align(docs, A, B).count() == 0 and alignment.token_groups(docs, A, B).count() == 0
