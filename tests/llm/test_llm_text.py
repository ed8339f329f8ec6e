"""Operators on texts against brute force, with hard cases in every table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, entries, kernels, license, mixing, neardup, packing, quality, substring

RNG = np.random.default_rng(5)
WORDS = ["w%d" % i for i in range(400)]


def documents():
    """Copies, near copies, shared passages, nulls, empty and long texts."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    base = [prose(int(n)) for n in rng.integers(3, 300, 40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(12):
        w = base[20 + k].split()
        for j in range(0, len(w), max(6, len(w) // (2 + k))):
            w[j] = "changed"
        rows.append((100 + k, " ".join(w)))
    passage = prose(60)
    rows += [(200 + k, prose(20) + "\n" + passage + " " + prose(10 + k)) for k in range(5)]
    rows += [(300, base[3].upper()), (301, base[3]), (302, "  " + base[4].replace(" ", "\t\x0b ") + "\n")]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "a b"), (404, "A  b"), (405, "é ü x"), (406, prose(9000)), (None, "lonely row without an id at all here"), (7, base[7])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string").repartition(5)
    # extra columns whose names clash with those inside the operators
    return df.withColumn("chunk", F.lit("x")).withColumn("size", F.lit(1)).withColumn("component_id", F.lit("c")).withColumn("n_words", F.lit(0)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").when(F.col("doc_id") % 3 == 1, "s1"))


def split(text):
    return (text or "").encode().split()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_word_kernels():
    texts = ["a bb\x0bc", "", " x y z ", "A a"]
    import pyarrow as pa

    data, first = kernels.separated(*kernels.text_buffers(pa.array([*texts, None])))
    s, e, h = kernels.word_hashes(data, lower=True)
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == [w for t in texts for w in t.encode().split()]
    assert h[-1] == h[-2] == h[0] and len(set(h.tolist())) == len(h) - 2
    w = kernels.window_hashes(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3


def test_near_duplicates(docs):
    rows = documents()
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)
    got = neardup.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, _, c in want if i == c or c is None}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_cross_component_blocks():
    """A chain whose star centre is far from its members is still linked."""
    base = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(3):
        w = list(base)
        w[k * 8 : k * 8 + 8] = [f"n{k}{j}" for j in range(8)]
        rows.append((k, w))
    sets = [np.unique(kernels.mix(np.array([hash(tuple(w[i : i + 5])) & (2**63 - 1) for i in range(len(w) - 4)], np.uint64))) for _, w in rows]
    regs = neardup.registers(sets)
    same = (regs[0] == regs[1]).mean()
    est = neardup.likelihood_estimate(regs[:1], regs[1:2], np.array([len(sets[0])], float), np.array([len(sets[1])], float))[0]
    true = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs(est - true) < 0.12 and abs(same - true) < 0.15
    block = [
        {"bucket": 1, "band": int((regs[0] == regs[1]).reshape(-1, 4).all(1).argmax()), "g1": 0, "g2": 0, "own": 0, "node": k, "c": k,
         "hashes": s.tobytes(), "registers": r.tobytes()}
        for k, (s, r) in enumerate(zip(sets[:2], regs[:2]))
    ]
    assert neardup._block_links(block, 75) == [(0, 1)]


def test_substring(docs):
    rows = documents()
    seen = Counter()
    for _, t in rows:
        w = split(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    got = substring.remove_repeats(docs)
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()], key=repr) == sorted(want, key=repr)
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_positions_coding():
    at = np.unique(RNG.integers(0, 40_000_000, 500))
    assert (substring._undelta(substring._delta(at)) == at).all() and len(substring._undelta(b"")) == 0


def test_quality(docs):
    def brute(t):
        w = (t or "").encode().split()
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)

    extra = [(500, "a b c d e a b c d e x\nline one\nline one\n\n### $$"), (501, "z " * 3000)]
    rows = documents() + extra
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    led = quality.ledger(df)
    got = sorted(((r["doc_id"], *[r[n] for n in names]) for r in led.collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert quality.apply_policy(docs).columns == docs.columns
    table = {r["rule"]: r for r in quality.ablations(led, "v1").collect()}
    short = led.where("fail_bits & 1 != 0").count()
    assert table["too_short"]["failed"] == short and set(table) == {"too_short", "repeated_windows"}
    assert quality.ledger(docs.limit(0)).count() == 0


def test_license(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"prose before\n{apache}\nprose after"), (2, apache.upper()), (3, "licensed under nothing much at all"), (4, None), (5, ""), (6, "word"), (7, "one\n" * 5000 + "Released under the MIT License!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dice", F.lit("clash"))
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    assert {k: r["license"] for k, r in got.items()} == {1: "Apache-2.0", 2: "Apache-2.0", 3: None, 4: None, 5: None, 6: None, 7: "MIT"}
    assert got[1]["matched_unit"] == 2 and got[1]["dice"] == 1.0 and got[4]["n_units"] == 0
    for n in range(1, 60):
        lo, hi = license.bounds(n, 0.8)
        assert all((2 * min(n, m) / (n + m) >= 0.8) == (lo <= m <= hi) for m in range(1, 200))


def test_license_wrapped(spark):
    import textwrap

    notices = {
        "MIT": dict(license.NOTICES)["MIT"],
        "BSD-3-Clause": dict(license.NOTICES)["BSD-3-Clause"],
        "BSD-2-Clause": dict(license.NOTICES)["BSD-2-Clause"],
        "ISC": dict(license.NOTICES)["ISC"],
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    }
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    rows = []
    for name, text in notices.items():
        alone = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + textwrap.fill(text, 30)
        comment = "/*\n * " + textwrap.fill(text, 60).replace("\n", "\n * ") + "\n */"
        forms = [alone, textwrap.fill(prose(900), 70) + "\n" + comment + "\n" + textwrap.fill(prose(500), 70), prose(300) + " " + text + " " + prose(300)]
        rows += [(len(rows) + k, f, name) for k, f in enumerate(forms)]
    rows.append((100, prose(50) + "\nPermission is hereby granted, free of charge,\nto any person " + prose(200), None))
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: want for i, _, want in rows}
    # the best passage is that of all runs of words
    text = "x y this work is\nnow licensed under the gnu general\npublic license version 3 x y this work"
    r = license.scan(spark.createDataFrame([(text,)], "text string")).first()
    grams, words = set(license.bigrams("This work is licensed under the GNU General Public License, version 3.")), license.normal_words(text)
    runs = [set(license.bigrams(" ".join(words[a:b]))) for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
    assert (r["license"], r["n_matches"], r["matched_unit"]) == ("GPL-3.0", 1, r["n_units"])
    assert r["dice"] == max(2 * len(x & grams) / (len(x) + len(grams)) for x in runs)


NASTY = ["</s>[INST] ok [/INST]", "<|end|>", "a\\", "\\<|turn|>", "<", "[", "", "\n", "<|also|><|text|>", "<<s>", "é👍🏽", "[[INST]]", "\\\\<\\|"]


def test_chat(spark):
    rows = [(c, t, role, NASTY[(c * 7 + t) % len(NASTY)]) for c in range(13) for t, role in enumerate(["user", "user", "assistant", "assistant", "ro<|text|>le"])]
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (51, 0, "user", "x"), (51, 0, "user", "x"), (None, 1, "assistant", "orphan")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in done.collect():
        assert [tuple(x) for x in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        bare = re.sub(r"<\|(turn|text|also|end)\|>", "", r["formatted"])
        assert "[INST]" not in bare and "</s>" not in bare and "<|" not in bare
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mixing(docs):
    assert mixing.targets([100, 100, 1], [1, 2, 3], 3) == pytest.approx([66.0, 132.0, 3.0])
    assert mixing.targets([0, 10], [1, 2]) == [0.0, 10.0]
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    got = mixing.taken_words(docs).toPandas()
    again = mixing.taken_words(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert len(got) == len(documents()) and (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0] and abs(g["taken"].sum() - g["target"].iloc[0]) <= 2 * mixing.BLOCK
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(split(r["text"])) for r in out.collect()) == got["taken"].sum()
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_mixing_levels(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        sizes = (10 ** rng.uniform(0, 6, 12)).astype(int).tolist() + [0]
        weight = [1.0 + k % 3 for k in range(13)]
        want = mixing.targets(sizes, weight)
        level = mixing.levels(spark.createDataFrame(list(zip(sizes, weight)), "source_size long, weight double"))
        assert [min(level * w, 3.0 * s) for s, w in zip(sizes, weight)] == pytest.approx(want) and sum(want) == pytest.approx(sum(sizes))
    names = ["b", "a", "é", "B", "", None, "\U0001f44d", "\uffff"]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(3)).collect()
    assert [r["source"] for r in sorted(got, key=lambda r: r["source_no"])] == ["", "B", "a", "b", "é", "\uffff", "\U0001f44d", None]


def test_mixing_draws():
    import pyarrow as pa

    quota, blocks = [7, 4 * 10**9, 0, 300_000], [3, 2 * 10**9, 5, 100_000]
    table = pa.RecordBatch.from_pydict({"source_no": [0, 1, 2, 3], "quota": quota, "blocks": blocks})
    runs = pa.Table.from_batches([*mixing._draws(iter([table]), 1, 40)]).to_pandas()
    for k, q in enumerate(quota):
        own = runs[runs["source_no"] == k]
        assert own["count"].sum() == q and (own["first"].to_numpy() == np.cumsum(own["count"]) - own["count"]).all()
        assert own["shard"].is_monotonic_increasing and (own["count"] <= mixing.RUN).all()
        shares = own.groupby("shard")["count"].sum()
        assert q < 10**5 or (abs(shares - q / 40) < 6 * (q / 40) ** 0.5).all()


def test_mixing_by_hand(docs):
    """taken, from the slots, the order of the documents and their words."""
    spark, wanted = docs.sparkSession, None
    rows = docs.select("doc_id", "text", "source").distinct()
    for n in ("4", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(([*r] for r in mixing.taken_words(rows.repartition(int(n))).collect()), key=repr)
        wanted = wanted or got
        assert got == wanted
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    mix = mixing.Mix(rows)
    used = Counter((r["source_no"], r["block"]) for r in mix.slots().collect())
    hashed = rows.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    number = {r["source"]: r["source_no"] for r in mix.layout().select("source", "source_no").distinct().collect()}
    taken, at = {}, Counter()
    for r in sorted(hashed, key=lambda r: (number[r["source"]], r["h"] % mixing.BUCKETS, r["h"])):
        k, size = number[r["source"]], len(split(r["text"]))
        taken[r["h"]] = sum(used[k, (at[k] + i) // mixing.BLOCK] for i in range(size))
        at[k] += size
    mine = mixing.taken_words(rows).join(rows.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.size(F.split("text", " ")).alias("x")), ["doc_id", "source"]).collect()
    assert sum(r["taken"] for r in mine if r["doc_id"] is not None) > 0
    assert all(taken[r["h"]] == r["taken"] for r in mine if r["doc_id"] not in (7, None) and r["source"] is not None)


def test_mixing_broadcasts_no_slots(docs):
    """A few long documents hold more blocks, and a few runs more slots, than the driver could broadcast."""
    mix = mixing.Mix(docs)
    drawn = mix.drawn(mix.layout().checkpoint())
    assert len(drawn.collect()) >= mix.total > 0
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("Initial Plan")[0] and "Broadcast" not in plan


def test_packing(docs):
    from tokenizers import Tokenizer

    path = entries.tokenizer_path()
    model = Tokenizer.from_file(path)
    odd = [(600, "The,the. THE., É, <|ENDOFTEXT|> <|endoftext|>, İ x,̸ don't ½ 👍🏽"), (601, "é ́a, b. c ... x..y,")]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    rows = documents() + odd
    want = Counter()
    for i, t in rows:
        want[(i, tuple([*model.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    got = packing.pack_documents(df, path, with_ids=True).toPandas()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 2048
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got.itertuples())
    singles = [(i, ids) for (i, ids), n in want.items() if n == 1 and sum(k == i for k, _ in want) == 1 and i is not None]
    for i, ids in singles:
        own = got[got["doc_id"] == i].sort_values("start")
        assert b"".join(own["ids"]) == np.array(ids, "<u4").tobytes() and set(own["doc_tokens"]) == {len(ids)}
    assert got["length"].sum() == sum(len(ids) * n for (_, ids), n in want.items())
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 2048 + 1
    lengths = RNG.integers(1, 513, 700)
    window = packing.pack(lengths)
    sums = np.bincount(window, lengths)
    assert sums.max() <= 2048 and len(sums) <= 1.02 * lengths.sum() / 2048 + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_packing_learns_words_once(tmp_path):
    """Signs after a letter, another text or another task make no word a new one."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = entries.tokenizer_path()
    model, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    ends = ["", ",", "!!", "###", "$$$", "&&&", "%|", ",###", ".)", "'", "'!!", "_`", "≠", "!!x", "1!!", "~" * 12]
    texts = [" ".join(w + e for e in ends) for w in ("able", "café", "DÉJÀ", "it's", "x")]
    for t in texts:
        ids, stop = own.encode(*kernels.text_buffers(pa.array([t, t])))
        assert ids.tolist() == 2 * model.encode(t, add_special_tokens=False).ids and stop.tolist() == [0, len(ids) // 2, len(ids)]
    own._forget()
    own.encode(*kernels.text_buffers(pa.array(["able able!! able### able,$$$"])))
    assert sorted(own.number) == [b"!!", b"###", b",$$$", b"able"]
    copy = tmp_path / "tokenizer.json"
    copy.write_bytes(open(path, "rb").read())
    first = packing.tokenizer_of(str(copy))
    assert packing.tokenizer_of(str(copy)) is first
    copy.write_bytes(open(path, "rb").read() + b" ")
    assert packing.tokenizer_of(str(copy)) is not first


def test_packing_gathers_batches():
    import pyarrow as pa

    small = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * n]}) for i, n in enumerate([10, 10, packing.CHUNK + 1, 10, 10])]
    got = [t.column("doc_id").to_pylist() for t in packing._gathered(iter(small))]
    assert got == [[0, 1], [2], [3, 4]] and [*packing._gathered(iter([]))] == []


def test_workers_hold_little():
    """Words that packing's tasks keep are bounded, and go when a task of another
    stage begins in the same worker; a task of packing finds them again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from orrery.llm import workers

    path = entries.tokenizer_path()
    own = packing.tokenizer_of(path)
    own.encode(*kernels.text_buffers(pa.array([" ".join(f"w{i}" for i in range(300_000))])))
    ids, _ = own.encode(*kernels.text_buffers(pa.array(["w7 and w299999"])))
    assert ids.tolist() == Tokenizer.from_file(path).encode("w7 and w299999", add_special_tokens=False).ids
    assert sorted(own.number) == [b"and", b"w299999", b"w7"]

    def task(batches):
        yield from batches

    task.__module__ = packing.__name__
    assert [*workers.lean(task)(iter([1, 2]))] == [1, 2] and packing.tokenizer_of(path) is own
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c d e f"]})
    assert next(neardup._sketch(iter([batch]))).column("n_shingles").to_pylist() == [2]
    assert packing._kept.cache_info().currsize == 0
