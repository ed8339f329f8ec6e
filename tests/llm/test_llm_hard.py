"""Hard cases: collisions by construction, hot keys, repeats, clashing columns,
and the registered queries on the smallest tables."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, chat, components, entries, kernels, license, neardup, packing, quality, session, substring, text, warc

SF = "/root/testdata/sf0.001"


def thue_morse(n=10):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_patterned_words():
    a, b = thue_morse()
    short = [x[:64] for x in (a, b)]
    data = np.frombuffer(" ".join([a, b, *short, "a" * 9, "a" * 10, "a" * 65, "a" * 66]).encode(), np.uint8)
    for lane in (0, 1):
        starts, ends, h = kernels.word_hashes(data, False, lane)
        assert len(set(h.tolist())) == len(h) == 8
    assert not set(h.tolist()) & set(kernels.word_hashes(data, False)[2].tolist())
    # windows whose words follow the same pattern
    two = kernels.mix(np.array([1, 2], np.uint64))
    rows = [np.array([two[int(c == "b")] for c in x[:32]]) for x in (a, b)]
    assert kernels.window_hashes(rows[0], 32) != kernels.window_hashes(rows[1], 32)
    same = kernels.same_spans(data, starts, ends, np.array([0, 0, 2, 2, 4, 4, 6, 6]))
    assert same.tolist() == [True, False] * 4
    assert kernels.same_spans(data, starts[[0, 0]], ends[[0, 0]], np.array([1, 0])).all()


@pytest.mark.parametrize("width", [1, 2, 5, 18, 35])
def test_windows_are_known_by_their_words(width):
    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    known = {}
    for i, h in enumerate(kernels.window_hashes(words, width).tolist()):
        known.setdefault(h, set()).add(tuple(words[i : i + width].tolist()))
    assert all(len(x) == 1 for x in known.values())
    assert len(known) == len({tuple(words[i : i + width].tolist()) for i in range(401 - width)})


def test_patterned_words_stay_apart(spark):
    """Two words that collide under any polynomial modulo a power of two."""
    from tokenizers import Tokenizer

    a, b = thue_morse()
    shared = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"x {a} y z"), (4, f"x {b} y z")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(df).collect()} == {0}
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}  # 1 and 2: 30 of 32 shingles
    path = entries.tokenizer_path()
    model = Tokenizer.from_file(path)
    got = packing.pack_documents(df.coalesce(1), path, with_ids=True).toPandas()
    for i, t in ((r["doc_id"], r["text"]) for r in df.collect()):
        own = b"".join(got[got["doc_id"] == i].sort_values("start")["ids"])
        assert np.frombuffer(own, "<u4").tolist() == [*model.encode(t, add_special_tokens=False).ids, 1]


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(session, "HEAVY", 10)
    left = spark.createDataFrame([(k % 40 if k % 3 else 7, k) for k in range(600)], "k long, v long")
    right = spark.createDataFrame([(k, str(k)) for k in range(1, 40)], "k long, w string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    assert session.hot_keys(counts, "k", 600, 600) is None and session.hot_keys(counts, "k", 590, 600) is None
    hot = session.hot_keys(counts, "k", 20, 600)
    assert [r["k"] for r in hot.collect()] == [7]
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, session.join_spread(left, right, "k", hot).collect())) == want
    assert sorted(map(tuple, session.join_spread(left, right, "k", None).collect())) == want


def components_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hub", [4, 10_000])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2)) if a != b]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)] + [(9, 9), (5000, 5001)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    want = components_of([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0


def near_group(rng, n=60, size=80):
    base = [f"b{i}" for i in range(size)]
    rows = []
    for k in range(n):
        w = list(base)
        w[int(rng.integers(0, size))] = f"n{k}"
        rows.append((1000 + k, " ".join(w)))
    return rows


def test_hot_group_of_near_copies(spark, monkeypatch):
    """Buckets, centres, hubs and components beyond the bounds of hot keys."""
    for module, name in ((neardup, "SLICE"), (neardup, "BUCKET_SLICE"), (neardup, "SMALL_ROWS"), (components, "HUB")):
        monkeypatch.setattr(module, name, 6)
    rng = np.random.default_rng(8)
    rows = near_group(rng) + [(k, " ".join(f"r{i}" for i in rng.integers(0, 900, 60))) for k in range(30)] + [(2000 + k, "the very same words in every one of these") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: i for i in sets} | components_of(links)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == want and len([1 for v in want.values() if v == 1000]) > 50


def test_keep_one_judges_rows(spark):
    copy, lone, other = ("one two three four five six seven eight", "alone with these words in this row", "nothing that any other row says here")
    rows = [(1, copy), (2, copy), (1, lone), (3, other), (3, other), (4, lone.upper()), (5, ""), (5, None), (6, " "), (None, copy), (None, copy)]
    clash = ["__id", "id", "x", "row", "set_id", "stays", "d", "component_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)]).repartition(2)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    got[(5, "")] += got.pop((5, None), 0)
    assert got == Counter({(1, copy): 1, (1, lone): 1, (3, other): 1, (5, ""): 1, (6, " "): 1, (None, copy): 2})
    assert {tuple(r[c] for c in clash) for r in kept.collect()} == {tuple(range(len(clash)))}


def test_many_equal_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(t).alias("text"))
    cut = substring.remove_repeats(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert [tuple(r) for r in cut] == [(7, 40, 40, 10_000)]
    packed = packing.pack_documents(df, entries.tokenizer_path()).toPandas()
    assert packed["length"].sum() == 10_000 * packed["doc_tokens"].iloc[0]
    sums = packed.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 2048 and len(sums) <= 1.03 * sums.sum() / 2048 + 1
    assert neardup.keep_one(df).count() == 1
    nulls = df.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(300)
    assert neardup.keep_one(nulls).count() == 300 and substring.remove_repeats(nulls).where("n_removed = 40").count() == 300


def test_parts_of_the_index(spark, monkeypatch):
    """Chunks and parts of a few texts each give the same result."""
    rng = np.random.default_rng(6)
    passage = [" ".join(f"p{k}x{i}" for i in range(50)) for k in range(4)]
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 60)) + " " + passage[i % 4] + " end") for i in range(60)]
    rows += [(100, passage[0] + " " + passage[1]), (101, " ".join(passage[2].split()[:34])), (102, " ".join(passage[3].split()[5:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r["doc_id"], r["n_removed"], r["kept_sha256"])
    want = sorted(map(key, substring.remove_repeats(df).collect()))
    for name, size in (("CHUNK", 2000), ("PART", 3000), ("SETTLE", 1500)):
        monkeypatch.setattr(substring, name, size)
    assert sorted(map(key, substring.remove_repeats(df.repartition(3)).collect())) == want
    assert {i: n for i, n, _ in want if i >= 100} == {100: 100, 101: 0, 102: 35}


def test_search_block_by_block(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[1] + 0.001 * rng.normal(size=(300, 16)).astype(np.float32)
    books = ann.fit(ann.unit(x[::3].astype(np.float64)))
    monkeypatch.setattr(ann, "CLASS_BLOCK", 128)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = [pa.RecordBatch.from_pydict({"class": np.arange(a, a + 50), "vector": [v.tobytes() for v in x[a : a + 50]]}) for a in range(0, 900, 50)]
    index = [*ann._index(iter(rows), books)]
    ids = np.arange(0, 900, 20)
    found = pa.Table.from_batches([*ann._search(iter(index), ids, x[ids], books, 5, 16)]).to_pandas()
    u = ann.unit(x.astype(np.float64))
    for i in ids:
        want = np.argsort(-(u @ u[i]), kind="stable")[:6]
        assert found[found["query_id"] == i].sort_values(["score", "class"], ascending=[False, True])["class"].tolist() == want.tolist()


def test_search_in_turns(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    once = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(ann, "QUERY_BYTES", 400)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0).collect())) == once and len(once) == 200


@pytest.mark.parametrize("most, heavy", [(200_000, 10_000), (2, 1), (0, 1)])
def test_warc_of_hot_payloads(spark, tmp_path, monkeypatch, most, heavy):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    monkeypatch.setattr(warc, "HEAVY", heavy)
    pages = [(k, "u", "hot " * 40) for k in range(50, 90)] + [(k, "u", "pair%d " % (k // 2) * 30) for k in range(10)] + [(200 + k, None, None) for k in range(20)] + [(300 + k, "u", "short") for k in range(9)] + [(400, "u", "single " * 30)]
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), folder)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, files, folder).collect()}
    want = {i: ("response", None) for i, _, _ in pages} | {k: ("revisit", 50) for k in range(51, 90)} | {k: ("revisit", k - 1) for k in (1, 3, 5, 7, 9)}
    assert got == want
    warc.remove_folder(folder)
    assert not (tmp_path / "w").exists()


def test_quality_clashes(spark):
    rows = [(1, "### $$ " * 20), (2, " ".join(f"word{i}" for i in range(30))), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(5).alias(c) for c in ("__w", "__h", "___p", "n_words", "fail_bits", "row")])
    kept = quality.apply_policy(df)
    assert kept.columns == df.columns and [(r["doc_id"], r["n_words"], r["fail_bits"], r["__w"]) for r in kept.collect()] == [(2, 5, 5, 5)]
    led = {r["doc_id"]: r for r in quality.ledger(df).collect()}
    assert led[2]["n_words"] == 30 and led[2]["__w"] == led[2]["___p"] == 5 and led[3]["n_words"] == 0
    assert text.free_prefix(["a", "__w", "___x"]) == "____"


def test_license_by_hand(spark):
    """Whole texts and lines against every template, by sets of bigrams."""
    rng = np.random.default_rng(12)
    known = license.prepared()
    filler = [f"f{i}" for i in range(60)]
    rows = []
    for k, (_, body) in enumerate(license.TEMPLATES):
        w = body.split()
        less = [x for i, x in enumerate(w) if i % 9 != 4]
        rows += [(3 * k, body), (3 * k + 1, "\n".join([" ".join(rng.choice(filler, 12)), " ".join(less), body.upper()])), (3 * k + 2, " ".join(less))]
    rows += [(900, None), (901, ""), (902, "word"), (903, "  \n "), (904, license.TEMPLATES[2][1]), (904, license.TEMPLATES[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("c").alias(c) for c in ("__u", "__x", "license")])
    out = license.scan(df)
    assert out.count() == len(rows) and {"__u", "__x"} <= set(out.columns) and license.scan(df.limit(0)).count() == 0
    for r in out.collect():
        t = r["text"] or ""
        units = [t, *t.split("\n")] if "\n" in t else ([t] if license.normal_words(t) else [])
        scores = []
        for i, u in enumerate(units):
            own = set(license.bigrams(u))
            for k, (name, grams, lo, hi) in enumerate(known):
                d = 2 * len(own & set(grams)) / (len(own) + len(grams))
                if lo <= len(own) <= hi and d >= license.THRESHOLD:
                    scores.append((-d, k, i, name))
        assert r["n_units"] == len(units)
        if scores and r["matched_unit"] < r["n_units"]:  # no passage is better
            d, _, i, name = min(scores)
            assert (r["license"], r["matched_unit"]) == (name, i) and r["dice"] == pytest.approx(-d)
        elif scores:
            assert r["dice"] > -min(scores)[0]


def test_license_files(spark):
    """A licence file as projects have it."""
    import textwrap

    mit = dict(license.NOTICES)["MIT"]
    cut = mit.index("THE SOFTWARE IS")
    body = "\n\n".join(textwrap.fill(x, 78) for x in (mit[: mit.index("The above copyright")], mit[mit.index("The above copyright") : cut], mit[cut:]))
    rows = [(1, "MIT License\n\nCopyright (c) 2026 Somebody\n\n" + body + "\n"), (2, "The MIT License (MIT)\r\n" + body.replace("\n", "\r\n"))]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["license"] for r in got] == ["MIT"] * 2


def test_license_templates_of_ones_own(spark):
    own = (("Mine", "You may read this text aloud on Sundays only, and never to a cat."),)
    rows = [(1, "x y\nyou may read this text aloud on sundays only, and never to a cat\nz"), (2, license.TEMPLATES[0][1]), (3, "so you may read this text\naloud on Sundays only, and never\nto a cat of mine or yours")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license.scan(df, templates=own, notices=()).collect()}
    assert got == {1: "Mine", 2: None, 3: "Mine"}


def test_workers_without_the_repository(tmp_path):
    """Workers get the subpackage from the session, not from their path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(packing.__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from orrery.llm import entries, packing
docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
print("rows", packing.pack_documents(docs, entries.tokenizer_path()).count())
"""
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=280)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_chat_of_long_conversations(spark):
    rng = np.random.default_rng(2)
    roles = ["user", "assistant", "tool"]
    rows = [(1, t, roles[int(rng.integers(0, 3))] if t > 500 else "assistant", f"text {t} <|end|>" * int(rng.integers(0, 3))) for t in range(1500)]
    rows += [(2, 0, "user", "x"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("t", "starts", "lengths", "before", "formatted")])
    done = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [tuple(x) for x in got[1]["turns"]] == [(role, t) for _, _, role, t in rows[:1500]]
    assert got[1]["loss"] == "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    runs = sum(1 for a, b in itertools.pairwise([None, *(r[2] for r in rows[:1500])]) if a != b)
    assert got[1]["formatted"].count("<|turn|>") == runs  # adjacent turns of a role are one block
    assert got[2]["loss_spans"] == [] and got[3]["formatted"] == "<|turn|><|text|><|end|>"


def test_prefix_sums(spark):
    sizes = [0, 1, 2, 3, 10, 99, 100, 101]
    rows = [(n, list(range(n))) for n in sizes]
    got = spark.createDataFrame(rows, "n int, a array<long>").select("n", chat.prefix_sums("a").alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: [0, *itertools.accumulate(range(n))][:n] for n in sizes}


def test_registered_search(spark):
    got = entries.op2_nearest_neighbours(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(rows["embedding"]).astype(np.float64)
    ids = rows["vec_id"].to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.where(ids == ids[i], -9, u @ u[i])
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        assert own["vec_id"].tolist() == ids[np.lexsort((ids, -np.round(s, 13)))[:5]].tolist()
        assert own["score"].to_numpy() == pytest.approx(np.sort(s)[::-1][:5], abs=1e-14)


def test_registered_mix(spark):
    got = entries.op5_source_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    docs["size"] = [len((t or "").encode().split()) for t in docs["text"]]
    sizes = docs.groupby("source", dropna=False)["size"].sum()
    names = sorted((s for s in sizes.index if isinstance(s, str))) + [s for s in sizes.index if not isinstance(s, str)]
    from orrery.llm import mixing

    want = dict(zip(names, mixing.targets([int(sizes[s]) for s in names], [1.0 + k % 3 for k in range(len(names))])))
    got = got.merge(docs[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_own"))
    assert len(got) == len(docs) and (got["size"] == got["size_own"]).all() and (got["taken"] <= 3 * got["size"]).all()
    for s, g in got.groupby("source", dropna=False):
        assert g["target"].iloc[0] == pytest.approx(want[s]) and abs(g["taken"].sum() - want[s]) <= 2 * mixing.BLOCK


def test_registered_languages(spark):
    got = entries.op6_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    docs["odd"] = [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs["doc_id"]]
    both = got.merge(docs, on="doc_id")
    assert (both["held_out"] == both["odd"]).all() and both["score"].between(0, 1).all()
    blind = both[both["held_out"] & both["lang"].notna() & (both["lang_pred"] != "und")]
    assert (blind["lang"] == blind["lang_pred"]).mean() >= 0.97


def test_registered_packing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(entries.tokenizer_path())
    got = entries.op9_packing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == i].sort_values("start")
        assert own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()


def test_registered_archives(spark):
    got = {r["page_id"]: r for r in entries.op7_warc(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        raw = (p["html"] or "").encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_pipeline_of_hard_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"word{i}" for i in rng.integers(0, 2000, n))
    good = text(90)
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (None, text(60), None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, good.upper(), "en", None), (5, text(5000), "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.select("*", *[F.lit(9).alias(c) for c in ("__row", "__w", "__id", "chunk", "size", "grp", "sk", "start")])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"].dropna()) == {1, 5} and got["doc_id"].isna().any()
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and {r["__row"] for r in docs.select("__row").collect()} == {9}
        docs = docs.checkpoint()
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
