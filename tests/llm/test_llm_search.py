"""Nearest neighbours, language ID, WARC and the pipeline."""

import hashlib
import io
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, entries, langid, warc

RNG = np.random.default_rng(11)


def vectors():
    x = RNG.normal(size=(600, 10)).astype(np.float32)
    x[100:200] = x[50]  # a very common vector
    x[300] = 3 * x[51]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 10), (1100, [float("nan")] * 10), (1150, [1.0] * 3), (1200, []), (None, x[3].tolist()), (1250, [1.0, None] + [0.0] * 8), (1300, [float("inf")] + [0.0] * 9), (5, x[5].tolist())]
    return rows


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and len(v) == 10 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    hit = total = 0
    for i in ids[ids % 50 == 0]:
        s = np.round(u @ u[ids == i][0], 12)
        s[ids == i] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        own = got[got["query_id"] == i].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(want) & set(own["vec_id"])), total + 5
        if i in (100, 150):
            assert own["vec_id"].tolist() == want
    assert set(got["query_id"]) == set(ids[ids % 50 == 0].tolist()) and hit / total >= 0.9
    few = ann.nearest(df.where("vec_id < 3"), F.lit(True)).toPandas()
    assert len(few) == 6
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def near_copies():
    """Vectors a third of which are one cluster of near copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 64))
    x[:1365] = x[0] + 0.005 * rng.normal(size=(1365, 64))
    return x.astype(np.float32)


def test_nearest_among_near_copies(spark):
    x = near_copies()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    u = ann.unit(x.astype(np.float64))
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[i] = -9
        assert got[got["query_id"] == i].sort_values("rank")["vec_id"].tolist() == np.argsort(-s)[:5].tolist()


def test_bound_holds_for_all_rows():
    x, q = ann.unit(near_copies().astype(np.float64)), ann.unit(RNG.normal(size=(20, 64)))
    books = ann.fit(x[::4])
    codes = ann.encode(x, books)
    made = np.concatenate([books[j][codes[:, j]] for j in range(len(books))], 1)
    tables, step, shift = ann._tables(q, books)
    decoded = (ann._sums(tables, ann.pack4(codes)) + len(books) / 2) * step[:, None] + shift[:, None]
    assert (decoded >= q @ made.T - 1e-12).all()
    for a, row in zip(q @ x.T, decoded):
        for score in np.quantile(a, [0.01, 0.5, 0.9, 0.999]):
            assert (row >= ann.least(score, *ann.residuals(x, codes, books)))[a >= score].all()


def test_sums_of_wide_vectors():
    for m in (257, 258, 768):
        assert (ann._sums(np.full((2, m, 16), 255, np.uint16), ann.pack4(np.zeros((3, m), np.uint8))) == 255 * m).all()


def test_anisotropic_codes():
    x = ann.unit(RNG.normal(size=(500, 8)))
    books = ann.fit(x)
    codes = ann.encode(x, books)
    made = np.concatenate([books[j][codes[:, j]] for j in range(len(books))], 1)
    along = ((x - made) * x).sum(1)
    plain = np.concatenate([books[j][((x.reshape(500, -1, 2)[:, j, None] - books[j]) ** 2).sum(2).argmin(1)] for j in range(len(books))], 1)
    assert (along**2).mean() < (((x - plain) * x).sum(1) ** 2).mean()
    exact = np.stack([made @ q for q in x[:5]])
    approx = ann.scan(x[:5], ann.pack4(codes), books).astype(float)
    assert all(np.corrcoef(a, b)[0, 1] > 0.99 for a, b in zip(exact, approx))


def test_forward_sums_all_segmentations():
    pieces, word = ["a", "b", "ab", "ba", "aba"], "ababx"
    prob = np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])

    def total(rest):
        if not rest:
            return 1.0
        return sum(prob[i, 0] * total(rest[len(p) :]) for i, p in enumerate(pieces) if rest.startswith(p)) + (langid.UNKNOWN * total(rest[1:]) if rest[0] not in pieces else 0)

    got = langid.Lattice(["b", word, "a"], {p: i for i, p in enumerate(pieces)}).log_likelihood(prob)
    assert np.exp(got[:, 0]) == pytest.approx([0.2, total(word), 0.1])


def test_expected_counts():
    pieces = ["a", "b", "ab"]
    own = np.array([[0.3], [0.3], [0.4]])
    got = langid.Lattice(["ab", "a"], {p: i for i, p in enumerate(pieces)}).expected(own, np.array([2.0, 1.0]), 3)
    split, whole = 0.09 / 0.49, 0.4 / 0.49
    assert got == pytest.approx([2 * split + 1, 2 * split, 2 * whole])


@pytest.mark.parametrize("n", [200, 100_000])
def test_long_words(n):
    pieces = ["a", "b", "ab"]
    number = {p: i for i, p in enumerate(pieces)}
    prob = np.array([[0.3, 0.001], [0.3, 0.001], [0.4, 0.002]])
    lattice = langid.Lattice(["ab" * (n // 2), "x" * n, "b"], number)
    got = lattice.log_likelihood(prob)
    assert got[0] == pytest.approx(n / 2 * np.log(prob[0] * prob[1] + prob[2]))
    assert got[1] == pytest.approx(np.full(2, n * np.log(langid.UNKNOWN))) and got[2] == pytest.approx(np.log(prob[1]))
    counts = lattice.expected(prob[:, :1], np.array([2.0, 1.0, 3.0]), 3)
    assert counts == pytest.approx(n * np.array([0.09, 0.09, 0.4]) / 0.49 + [0, 3, 0])
    languages, made = langid.fit({"p": {"ab" * (n // 2): 1, "a": 4}, "q": {"b": 9, "x" * n: 1}}, pieces, rounds=1)
    assert np.isfinite(made).all() and made[0, 0] > made[0, 1]
    total, _ = langid.Scorer(pieces, made).texts(["ab" * (n // 2) + " a", "b " * 5 + "x" * n])
    assert total[0].argmax() == 0 and np.isfinite(total).all()


def test_language(spark):
    say = {"en": "the quick brown fox jumps over the lazy dog and then it runs away", "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann weg", "fr": "le rapide renard brun saute par dessus le chien paresseux puis il part"}
    rows = [(k, " ".join(RNG.permutation(t.split())), lang, "s") for k, (lang, t) in enumerate(list(say.items()) * 20)]
    vocab = langid.vocabulary(entries.tokenizer_path(entries.PIECES))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train(df, vocab)
    hard = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 !? 3"), (1003, "The DOG " * 4000), (1004, "中文")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(hard, vocab, *model).collect()}
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "en" and got[1004]["lang_pred"] in say
    back = {r["doc_id"]: r for r in langid.predict(df.select("doc_id", "text"), vocab, *model).collect()}
    assert sum(back[k]["lang_pred"] == lang for k, _, lang, _ in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in back.values())
    none = langid.train(df.limit(0), vocab)
    assert langid.predict(hard, vocab, *none).where("lang_pred <> 'und'").count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "text é " * 40
    rows = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (9, "http://c", big), (4, "http://d", "short"), (6, "http://e", "short"), (7, "u", None), (8, "", ""), (None, "n", big), (10, "x", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50), (11, "y", os.urandom(4000).hex())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = f"file://{tmp_path}/warc"
    files = warc.write_archives(df, folder)
    for split in (50, 700, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(spark, files, folder, split=split, with_payload=True).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            raw = (html or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            if got[i]["record_type"] == "response":
                assert got[i]["payload"] == raw
        assert {i for i in got if got[i]["record_type"] == "revisit"} == {5, 9, None} and got[9]["refers_to"] == 3
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), folder + "0"), folder + "0").count() == 0


def test_reader_resists_damage_and_false_magic():
    one = warc._member(warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None))
    two = warc._member(warc.record(2, "u", b"y" * 500, hashlib.sha256(b"y" * 500).hexdigest(), None))
    store = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: magic shows inside
    inner = hashlib.sha256(one).hexdigest()
    fake = store.compress(warc.record(3, "u", one, inner, None)) + store.flush()
    data = one + fake + b"\x1f\x8b\x08garbage" + two + one[:40]
    f = io.BytesIO(data)

    def read(at, n):
        f.seek(at)
        return f.read(n)

    whole = [warc.parse(r)[0] for r in warc.members(read, 0, len(data), len(data))]
    assert whole == [1, 3, 2]
    cut = [warc.parse(r)[0] for a in range(0, len(data), 37) for r in warc.members(read, a, min(a + 37, len(data)), len(data))]
    assert 2 in cut and cut.count(1) >= 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(RNG.choice(words, n))
    shared = text(80)
    rows = [(i, text(150), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, "### " * 40, "en", "s1"), (102, "too short", "en", "s1"), (103, text(40) + " " + shared, "en", "s2"), (104, shared + " " + text(40), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, ids = df, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == df.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert ids["quality_rules"] == {r[0] for r in rows} - {101, 102}
    assert ids["near_dedup"] == ids["quality_rules"] - {100} == ids["substring_dedup"]
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert all(len(left[i].split()) == 40 for i in (103, 104)) and left[5] == rows[5][1]
    from collections import Counter
    import tokenizers

    mixed = Counter()
    model = tokenizers.Tokenizer.from_file(entries.tokenizer_path())
    for r in spark.read.parquet(f"{tmp_path}/source_mixing").collect():
        mixed[(r["doc_id"], tuple([*model.encode(r["text"], add_special_tokens=False).ids, 1]))] += 1
    total = sum(len(k[1]) * n for k, n in mixed.items())
    packed = spark.read.parquet(f"{tmp_path}/packing").toPandas()
    assert packed["length"].sum() == total
    assert cp.run(spark, str(tmp_path)).count() == len(packed)
