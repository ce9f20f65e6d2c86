"""Whole queries and stages: columns and types by contract, brute force, odd tables, other cuts of the files."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from likegraph.llm import brown, chat, digest, minhash, packing, queries, shared, token_files, tokens
from likegraph.workers import let_workers_import
from tests.llm.test_llm import BYTE, SCHEMA, some_docs

COLUMNS = {
    "op1_language_mixture": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_simple8b_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_preference_formatting": "conv_id bigint, n_common int, prompt string, chosen string, chosen_mask string, rejected string, rejected_mask string",
    "op5_secret_links": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_quartile_digest": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_minhash_bayes": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_brown_class_ngrams": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_string_tiling": "doc_id bigint, best_item bigint, coverage double, items array<bigint>, contaminated boolean",
    "op10_pu_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    let_workers_import(spark)


@pytest.fixture(scope="module")
def rows():
    return some_docs(3, 40)


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """All tables with odd rows, and the same without any rows."""
    out = []
    for keep in (True, False):
        path = tmp_path_factory.mktemp("tables")
        for name, data, schema in (
            ("documents", rows, SCHEMA),
            ("benchmark", [(1, rows[5][1]), (2, None), (None, "a b c"), (1, rows[5][1])], "item_id long, text string"),
            ("labels", [(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int"),
            ("conversations", [(i, t, "user" if t % 2 == 0 else "assistant", f"said {t}") for i in range(5) for t in range(4)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string"),
        ):
            table = spark.createDataFrame(data, schema)
            (table if keep else table.limit(0)).repartition(3).write.parquet(str(path / f"{name}.parquet"))
        out.append(str(path))
    return out


@pytest.mark.parametrize("name", COLUMNS)
def test_query_has_its_columns(spark, tables, rows, name):
    full, empty = (queries.QUERIES[name](spark, path) for path in tables)
    want = [c.split() for c in COLUMNS[name].split(", ")]
    for out in (full, empty):
        assert [[f.name, f.dataType.simpleString()] for f in out.schema][: len(want)] == want
    assert empty.count() == 0
    got = full.collect()
    if name == "op4_preference_formatting":
        assert len(got) == 6
    elif name == "op2_best_fit_packing":
        assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(r[0] for r in rows)
    else:
        assert Counter(x["doc_id"] for x in got) == Counter(r[0] for r in rows)


def test_stages_of_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables[1]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[1])
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables[1]).count() == 0
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_stages_outlast_other_cuts(spark, tmp_path):
    """Each stage keeps the same rows when its result is read with files cut otherwise than when it was planned."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(f"item{i}" for i in range(20))
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(150)]
    texts += [texts[k] for k in range(0, 60, 3)] + [f"{texts[k][:50]} {item} end" for k in range(20)] + [None, "12 34"] * 8 + [f"key {k} token=abcdefghijk{k}x" for k in range(20)]
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(16, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        seen = []
        out = stage(spark, now, str(tmp_path))
        for cut in ({}, {"spark.sql.files.maxPartitionBytes": "1"}, {"spark.sql.leafNodeDefaultParallelism": "2", "spark.sql.files.openCostInBytes": "1"}):
            for k, v in cut.items():
                spark.conf.set(k, v)
            try:
                again = spark.createDataFrame(out.collect(), out.schema)
                seen.append(sorted(map(str, again.select("doc_id", *(c for c in ("text", "piece") if c in out.columns)).collect())))
            finally:
                for k in cut:
                    spark.conf.unset(k)
        assert seen[0] == seen[1] == seen[2], name
        sizes.append(len(seen[0]))
        if name != corpus_pipeline.STAGES[-1][0]:
            out.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
    assert sizes == [210, 190, 170, 170, 170]


def test_answers_of_the_next_conversation(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "x"), (2, 1, "assistant", "b"), (2, 2, "user", "tail"), (3, 0, "user", "none"), (None, 0, "user", "n"), (None, 1, "assistant", "a"), (4, 0, "assistant", "long " * 100_000), (4, 0, "assistant", "long " * 100_000)]
    convs = chat.turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")))
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.with_other_answers(convs).collect()}
    assert got[1] == ["hi", "b"] and got[2] == ["x", "", "tail"] and got[3] == ["none"] and got[None] == ["n", ""]
    assert got[4] == ["long " * 100_000, ""]
    pairs = {r["conv_id"]: r for r in chat.preferences(convs, chat.with_other_answers(convs)).collect()}
    assert pairs[1]["n_common"] == 1 and pairs[3]["n_common"] == 1 and pairs[3]["chosen"] == "" == pairs[3]["rejected"]
    assert pairs[4]["n_common"] == 1 and len(pairs[4]["chosen"]) > 500_000
    assert chat.with_other_answers(convs.limit(0)).count() == 0


def slow_digest(text):
    """Counts of hashed triplets in windows of five, quartiles of all buckets, the length and ratios of quartiles."""
    data = text.encode()
    counts = Counter()
    for i in range(len(data)):
        for (j, k), salt in zip(digest.TRIPLETS, digest._SALTS, strict=True):
            if i + k < len(data):
                counts[int(digest._ROLES[0][data[i]]) ^ int(digest._ROLES[1][data[i + j]]) ^ int(digest._ROLES[2][data[i + k]]) ^ salt] += 1
    full = [counts.get(b, 0) for b in range(digest.BUCKETS)]
    row = sorted(full)
    q = [row[digest.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return min(255, round(digest.LENGTH_STEPS * math.log1p(len(data)))), [x * 15 // max(q[2], 1) for x in q[:2]], [sum(c > x for x in q) for c in full]


def slow_likeness(a, b):
    total = min(24, abs(a[0] - b[0])) + sum(min(abs(x - y), 16 - abs(x - y)) for x, y in zip(a[1], b[1], strict=True))
    total += sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[2], b[2], strict=True))
    return 1 - min(total, digest.BOUND) / digest.BOUND


def test_digests_row_by_row(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (0, 1, 2, 5, 6, 40, 40, 300, 301, 900)] + ["same text here"] * 3
    ids = r.sample(range(1000), len(texts))
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    got = {x["doc_id"]: x for x in digest.fingerprints(d).collect()}
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, cut, nxt = slow_digest(t), slow_digest(edited), slow_digest(after)
        assert got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(slow_likeness(own, cut)) and got[i]["near_next"] == pytest.approx(slow_likeness(own, nxt))
        codes = digest.from_hex(got[i]["fingerprint"]).tolist()
        assert codes == [own[0], *own[1], *own[2]]


def test_brown_scores_by_counting(spark, monkeypatch, tmp_path):
    """score, token by token, from the classes alone: all counts are taken anew from the texts."""
    r = random.Random(7)
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    texts = [" ".join(w for _ in range(20) for w in (one[int(r.random() ** 2 * 60)], two[int(r.random() ** 2 * 60)])) for _ in range(60)]
    texts += ["", None, "never met here", texts[0], "A1 b2 A1"] + [f"once{i} twice{i % 9} a1" for i in range(18)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"Score": F.lit("own"), "rid": F.lit(1)}).repartition(4).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    seen = {}
    train, placed = brown.train, brown.placed_tail
    monkeypatch.setattr(brown, "train", lambda rows, dictionary, sums, **o: seen.setdefault("model", (train(rows, dictionary, sums, **o), dictionary))[0])

    def keep_tail(*a):
        out = placed(*a)
        seen["tail"] = {bytes(x["word"]): x["place"] for x in out[0].collect() if x["place"] is not None}
        return out

    monkeypatch.setattr(brown, "placed_tail", keep_tail)
    fold = lambda i: i % 4 != 1
    out = brown.score(d, F.col("doc_id") % 4 != 1, keep=["doc_id", "Score", "rid"], dictionary_size=50, classes=5, exchanged=20)
    assert out.columns[:3] == ["doc_id", "_Score", "rid"]
    got = {x["doc_id"]: x for x in out.collect()}
    model, dictionary = seen["model"]
    place = {w: i for i, w in enumerate(dictionary)} | seen["tail"]
    assert len(seen["tail"]) > 50
    said = {i: [*(t or "").encode().lower().split(), brown.END] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in said.items() if fold(i) for w in ws)
    assert {w for w, n in count.items() if n >= 2 and w != brown.END} <= set(place)
    rare = 5
    of = lambda w: int(model["of"][place[w]]) if w in place else rare
    moves = Counter()
    for i, ws in said.items():
        if fold(i):
            moves.update(zip([of(brown.END), *map(of, ws)], map(of, ws)))
    total, into, outof = sum(moves.values()), Counter(), Counter()
    for (a, b), n in moves.items():
        into[b] += n
        outof[a] += n
    share = {c: (into[c] + 0.5) / (total + 0.5 * 6) for c in range(6)}
    ones, twos = sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
    discount = min(max(ones / (ones + 2 * twos), 0.05), 0.95)
    rare_words = [w for w in count if of(w) == rare]
    rare_n = sum(count[w] for w in rare_words)
    for i, ws in said.items():
        want, before = 0.0, of(brown.END)
        for w in ws:
            c = of(w)
            want += math.log10((moves[before, c] + 5 * share[c]) / (outof[before] + 5))
            if c != rare:
                want += math.log10(count[w] / into[c])
            else:
                want += math.log10((count[w] - discount if w in count else discount * len(rare_words)) / rare_n)
            before = c
        assert got[i]["score"] == pytest.approx(want, abs=1e-6), i


def test_files_of_empty_texts(spark):
    d = spark.createDataFrame([(i, None if i % 2 else "") for i in range(6000)], "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(d, BYTE, file_docs=500)
    # a file ends with the batch in which it is full
    assert manifest.count() >= 6 and manifest.agg(F.max(F.size("doc_ids"))).first()[0] <= 1500
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == list(range(6000)) and all(x["n_tokens"] == 1 and x["start"] == x["doc_id"] for x in got)


def test_packing_without_broadcast(spark, monkeypatch):
    """Plans too large to broadcast meet the pieces of a hot length in several tasks."""
    r = random.Random(1)
    cuts = spark.createDataFrame([(i, 0, 7 if i % 3 else r.randint(1, 20)) for i in range(3000)], "doc_id long, piece int, length long").repartition(4)
    want = packing.packed(cuts, 20).toPandas()
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    got = packing.packed(cuts, 20).toPandas()
    for x in (want, got):
        assert len(x) == 3000 and x.doc_id.nunique() == 3000
        x = x.sort_values(["sequence_id", "offset"])
        assert ((x.groupby("sequence_id").length.cumsum() - x.length) == x.offset).all() and x.groupby("sequence_id").length.sum().max() <= 20
    assert want.sequence_id.nunique() == got.sequence_id.nunique()


def test_hot_groups_are_dealt(spark, monkeypatch):
    """Exact and near copies, more than a task takes of one key: same groups as with keys left whole."""
    from likegraph import spread

    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(50)]
    texts = [" ".join(base)] * 60 + ["", None] * 20
    for _ in range(60):
        w = list(base)
        w[r.randrange(50)] = r.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(words) for _ in range(20)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit(0), "root": F.lit("x")}).repartition(4)
    want = sorted(map(tuple, minhash.near_duplicates(d, k=2).collect()))
    monkeypatch.setattr(spread, "LEAST", 3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert sorted(map(tuple, minhash.near_duplicates(d, k=2).collect())) == want


def test_long_chunks_of_text():
    coder = tokens.ChunkEncoder(BYTE)
    text = "word " * 60_000 + "x" * 20_000
    ids, ends = coder.encode([text, ""])
    assert ids[: ends[0]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids and ends[1] == ends[0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, _):
            return None

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(session)
