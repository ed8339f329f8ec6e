"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct 5-word shingles (A-Z lower-cased). Each of
128 registers keeps the exponentially spaced, truncated minimum of a hash of
the set; registers of two sets merge by max, and agree with probability near
the Jaccard similarity J. Bands of four registers give candidates, all 128
estimate J jointly by likelihood, and the full sets confirm.

At J = 0.75 the chance that none of the 32 bands agrees is (1 - J**4)**32,
under 1e-5, and the estimate falls below its floor of 0.55 with a chance under
1e-6.

Groups stay cheap whatever their size. Equal sets are one class, with one row
from then on. Within a band's bucket every class is compared to one of them
only (a star). Where that leaves a bucket in several components, classes
of different components are compared with each other, so that no link between
components is lost: blocks of 1024 classes (or fewer long ones) meet in one task
at a time, which looks at a pair in the first band that both share, and returns
only links that join components. A star's members travel in slices of 256, and
the centre's sketch and set are sent once for each slice. Rows of hot buckets,
centres and hubs are not shuffled by those keys.

Sets are compared by whole 64-bit hashes of shingles, and known by 128 bits.

Defined results: null, empty and blank texts have an empty set and link with
nothing; texts of one to four words are one shingle; equal rows share a
component; rows of one doc_id and different texts go to the component of their
own texts; a null doc_id links nothing, and its row's component is that of its
class, or null; very long texts are hashed whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import kernels
from orrery.llm.components import connected_components
from orrery.llm.session import SMALL_ROWS, hot_keys, join_spread, nullable, prepare
from orrery.llm.workers import lean

SHINGLE = 5
REGISTERS, BAND = 128, 4
#: SetSketch: base of the registers' scale, rate, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, 65534
FLOOR = 0.55
#: Sets of so few shingles are known by a second hash of each.
FEW = 8
#: Members of a star that one slice compares; classes and shingles that a slice
#: of a bucket holds about; ids that a broadcast may hold.
SLICE, BUCKET_SLICE, SLICE_SHINGLES, BROADCAST_IDS = 256, 1024, 1 << 21, 200_000
#: Bytes of text hashed at once.
CHUNK = 1 << 20


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text, its distinct shingle hashes in ascending order, and the
    128 bits that the set is known by."""
    for part in kernels.blocks(np.diff(at), CHUNK):
        data, first = kernels.separated(raw, at[part.start : part.stop + 1])
        starts, ends, words = kernels.word_hashes(data, lower=True)
        cut = np.searchsorted(starts, first)

        def windows(own: np.ndarray) -> np.ndarray:
            return kernels.window_hashes(own, min(len(own), shingle)) if len(own) else own

        for i in range(len(first) - 1):
            lo, hi = cut[i], cut[i + 1]
            own, again = np.unique(windows(words[lo:hi])), b""
            if 0 < len(own) <= FEW:
                again = np.unique(windows(kernels.span_hashes(data, starts[lo:hi], ends[lo:hi], True, 1))).tobytes()
            yield own, hashlib.blake2b(own.tobytes() + again, digest_size=16).digest()


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = kernels.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    return seeds[:REGISTERS] | np.uint64(1), seeds[REGISTERS:]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 (set, register) of non-empty sets."""
    a, b = _coefficients()
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for part in kernels.blocks(np.array([len(s) for s in sets]), 1 << 17):
        own = sets[part]
        flat = np.concatenate(own)
        at = np.concatenate(([0], np.cumsum([len(s) for s in own])[:-1]))
        scratch = np.empty_like(flat)
        least = np.empty((REGISTERS, len(own)), np.uint64)
        for k in range(REGISTERS):
            np.multiply(flat, a[k], out=scratch)
            scratch += b[k]
            least[k] = np.minimum.reduceat(scratch, at)
        unit = (least.astype(np.float64) + 0.5) / 2.0**64
        spaced = np.floor(1 - np.log(-np.log1p(-np.minimum(unit, 1 - 1e-16)) / RATE) / np.log(BASE))
        out[part] = np.clip(spaced, 0, LARGEST + 1).astype(np.uint16).T
    return out


@lean
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, ids = [*zip(*shingle_sets(*kernels.text_buffers(batch.column("text"))), strict=True)] or [(), ()]
        first = {d: i for i, d in reversed(list(enumerate(ids))) if len(sets[i])}
        rows = registers([sets[i] for i in first.values()]) if first else None
        sketch = {d: rows[k].tobytes() for k, d in enumerate(first)}
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([sketch.get(d) for d in ids], pa.binary())],
            names=["doc_id", "n_shingles", "set_id", "registers"],
        )


def likelihood_estimate(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches whose
    set sizes are known, from how many registers are greater, less and equal."""
    more = (r1 > r2).sum(1)[:, None]
    less = (r1 < r2).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (n1 / (n1 + n2))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 201)[None, :] * most

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - (1 - u) * grid), chance((1 - u) - u * grid)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


@lean
def _likely(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        r1, r2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        n1, n2 = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        keep = likelihood_estimate(r1, r2, n1, n2) >= floor
        yield batch.drop_columns(["ra", "rb", "na", "nb"]).filter(pa.array(keep))


def _own_sets(batch: pa.RecordBatch) -> tuple[list[np.ndarray], pa.RecordBatch]:
    """The sets of those rows whose text is one that their class has, and the
    rows without set_id and text."""
    found = list(shingle_sets(*kernels.text_buffers(batch.column("text"))))
    right = np.array([d == own for (_, d), own in zip(found, batch.column("set_id").to_pylist(), strict=True)], bool)
    sets = [s for (s, _), ok in zip(found, right, strict=True) if ok]
    return sets, batch.drop_columns(["set_id", "text"]).filter(pa.array(right))


@lean
def _with_sets(batches: Iterator[pa.RecordBatch], sketched: bool) -> Iterator[pa.RecordBatch]:
    """Rows with hashes (of a set) in place of set_id and text, and registers."""
    for batch in batches:
        sets, kept = _own_sets(batch)
        out = kept.append_column("hashes", pa.array([s.tobytes() for s in sets], pa.binary()))
        if sketched:
            out = out.append_column("registers", pa.array([r.tobytes() for r in registers(sets)] if sets else [], pa.binary()))
        yield out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two ascending sets share."""
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    return int((x[place] == y).sum())


@lean
def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt, member), the centre's own (null member)
    first: links of members whose sets are similar enough. Holds one set."""
    at, own = None, None
    for batch in batches:
        a, b = [], []
        for centre, salt, member, packed in zip(*(batch.column(c).to_pylist() for c in ("centre", "salt", "member", "hashes")), strict=True):
            other = np.frombuffer(packed, np.uint64)
            if member is None:
                at, own = (centre, salt), other
            elif at == (centre, salt):
                both = _shared(own, other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(centre)
                    b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between components among one block's rows; each found link joins
    its components here, so that a block returns a spanning set of links."""
    first, second, band = rows[0]["g1"], rows[0]["g2"], rows[0]["band"]
    left = [r for r in rows if r["own"] == first]
    right = left if first == second else [r for r in rows if r["own"] == second]
    if not left or not right:
        return []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    def hashes(r: dict) -> np.ndarray:
        return np.frombuffer(r["hashes"], np.uint64)

    sketch = np.stack([np.frombuffer(r["registers"], np.uint16) for r in right])
    sizes = np.array([len(r["hashes"]) // 8 for r in right], float)
    group = np.array([r["c"] for r in right])
    links = []
    for i, r in enumerate(left):
        own = np.frombuffer(r["registers"], np.uint16)
        n = len(r["hashes"]) // 8
        near = (group != r["c"]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        if first == second:
            near[: i + 1] = False
        at = np.flatnonzero(near)
        if not len(at):
            continue
        shared = (sketch[at] == own).reshape(len(at), -1, BAND).all(2)
        at = at[shared.argmax(1) == band]
        if not len(at):
            continue
        at = at[likelihood_estimate(sketch[at], own[None, :], sizes[at], np.full(len(at), float(n))) >= FLOOR]
        for j in at.tolist():
            a, b = find(r["c"]), find(right[j]["c"])
            if a == b:
                continue
            x, y = hashes(r), hashes(right[j])
            both = _shared(x, y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[max(a, b)] = min(a, b)
                links.append((r["node"], right[j]["node"]))
    return links


@lean
def _confirm_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; one block (two slices of classes) is held."""
    at, rows = None, []

    def out():
        links = _block_links(rows, percent) if rows else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if (key := (row["bucket"], row["g1"], row["g2"])) != at:
                yield out()
                at, rows = key, []
            rows.append(row)
    yield out()


def _with_text(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """roles (doc, set_id, ...) with the documents' texts. Few roles are
    broadcast; of more, few distinct documents are, so that only their texts
    are shuffled."""
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where(F.col("doc").isNotNull())
    if roles.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(roles), "doc").drop("doc")
    wanted = roles.select("doc").distinct().checkpoint()
    if wanted.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted), "doc", "left_semi")
    return texts.join(roles, "doc").drop("doc")


def _star_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a: centre, b: member) that the full sets confirm. classes:
    node, doc, n, set_id, registers."""
    pairs = pairs.checkpoint()
    fan = pairs.groupBy("a").agg(F.count("*").alias("n"))
    hot = hot_keys(fan, "a", SLICE, pairs.count())
    slices = F.lit(1)
    if hot is not None:
        wide = fan.join(F.broadcast(hot), "a", "left_semi").select("a", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
        pairs, slices = pairs.join(F.broadcast(wide), "a", "left"), F.coalesce("slices", F.lit(1))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), slices).cast("int").alias("salt"))
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"), F.struct("doc", "set_id").alias(f"s{c}"))
    centres = dealt.select("a", "salt").distinct().join(side("a"), "a")
    met = dealt.join(side("b"), "b").join(centres, ["a", "salt"])
    kinds = "a long, salt int, b long, sa struct<doc:long,set_id:binary>, sb struct<doc:long,set_id:binary>"
    likely = met.select("a", "salt", "b", "sa", "sb", "na", "nb", "ra", "rb").mapInArrow(partial(_likely, floor=FLOOR), kinds).checkpoint()
    members = likely.select(F.col("a").alias("centre"), "salt", F.col("b").alias("member"), "sb.doc", "sb.set_id")
    own = likely.select(F.col("a").alias("centre"), "salt", F.lit(None).cast("long").alias("member"), "sa.doc", "sa.set_id").distinct()
    roles = members.unionByName(own).checkpoint()
    met = _with_text(docs, roles).select("centre", "salt", "member", "set_id", "text")
    sets = met.mapInArrow(partial(_with_sets, sketched=False), "centre long, salt int, member long, hashes binary")
    ready = sets.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())
    return ready.mapInArrow(partial(_confirm, percent=percent), "a long, b long").checkpoint()


def _cross_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, roots: DataFrame, hot: DataFrame | None, label: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that share a bucket. In each bucket the classes
    outside the root's component are dealt into slices, the others too; every
    slice of the former meets every slice."""
    own = bands.join(label.withColumnsRenamed({"component": "c"}), "node", "left").withColumn("c", F.coalesce("c", "node"))
    of_root = roots.join(label.select(F.col("node").alias("root"), F.col("component").alias("cr")), "root", "left").select("bucket", F.coalesce("cr", "root").alias("cr"))
    named = join_spread(own, of_root, "bucket", hot).checkpoint()
    out = F.col("c") != F.col("cr")
    sizes = named.groupBy("bucket").agg(*[f(w).alias(f"{k}{s}") for s, w in (("o", out), ("i", ~out)) for k, f in (("k", F.count_if), ("n", lambda w: F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0))))])
    sizes = sizes.where("ko > 0")
    many = lambda s: F.ceil(F.greatest(F.col(f"k{s}") / BUCKET_SLICE, F.col(f"n{s}") / SLICE_SHINGLES)).cast("int").alias(f"s{s}")
    dealt = join_spread(named, sizes.select("bucket", many("o"), many("i")), "bucket", hot)
    own = F.when(out, F.pmod(F.xxhash64("node"), F.col("so"))).otherwise(F.col("so") + F.pmod(F.xxhash64("node"), F.col("si"))).cast("int")
    upto = F.when(out, F.col("so") + F.col("si")).otherwise(F.col("so"))
    roles = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
        .select("node", "bucket", "band", F.least("own", "other").alias("g1"), F.greatest("own", "other").alias("g2"), "own", "c")
        .join(classes.select("node", "doc", "set_id"), "node")
    ).checkpoint()
    if roles.isEmpty():
        return None
    met = _with_text(docs, roles).select("bucket", "band", "g1", "g2", "own", "node", "c", "set_id", "text")
    kinds = "bucket long, band int, g1 int, g2 int, own int, node long, c long"
    sets = met.mapInArrow(partial(_with_sets, sketched=True), kinds + ", hashes binary, registers binary")
    ready = sets.repartition("bucket", "g1", "g2").sortWithinPartitions("bucket", "g1", "g2")
    return ready.mapInArrow(partial(_confirm_blocks, percent=percent), "a long, b long").checkpoint()


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id, holder (the set_id of the text
    that stands for the component) for every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_id binary, registers binary").checkpoint()
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
        .where("doc IS NOT NULL")
        # a number of its own for each class, made once and kept by the checkpoint
        .withColumn("node", F.monotonically_increasing_id())
    ).checkpoint()
    width = BAND * 2
    cuts = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.xxhash64(k, F.substring(F.col("registers"), k * width + 1, F.lit(width))))
    # a bucket's root is its oldest text, by doc_id: copies are nearer to what they
    # were copied from than to each other
    bands = classes.select("node", "n", "doc", F.posexplode(cuts).alias("band", "bucket"))
    roots = bands.groupBy("bucket").agg(F.min(F.struct("doc", "node", "n")).alias("root"), F.count("*").alias("size")).where("size > 1")
    bands = bands.drop("doc")
    roots = roots.select("bucket", F.col("root.node").alias("root"), F.col("root.n").alias("n_root"), F.col("size").alias("n")).checkpoint()
    hot = hot_keys(roots, "bucket", SMALL_ROWS, classes.count() * (REGISTERS // BAND))
    stars = join_spread(bands, roots.select("bucket", "root", "n_root"), "bucket", hot).checkpoint()
    near = f"node <> root AND 100 * least(n, n_root) >= {percent} * greatest(n, n_root)"
    links = _star_links(docs, classes, stars.where(near).select(F.col("root").alias("a"), F.col("node").alias("b")).distinct(), percent)
    label = connected_components(links).checkpoint()
    more = _cross_links(docs, classes, stars.select("node", "n", "band", "bucket"), roots.select("bucket", "root"), hot, label, percent)
    if more is not None and not more.isEmpty():
        label = connected_components(links.unionAll(more)).checkpoint()
    named = classes.select("node", "set_id", "doc").join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    named = named.select("set_id", "doc", "c").checkpoint()
    of = named.groupBy("c").agg(F.count("*").alias("n"), F.min("doc").alias("component_id"))
    large = hot_keys(of, "c", SMALL_ROWS, classes.count())
    placed = join_spread(named, of.drop("n"), "c", large)
    # of several texts under the component's id, one stands for it
    held = placed.where("doc = component_id").groupBy("c").agg(F.min("set_id").alias("holder"))
    placed = join_spread(placed, held, "c", large).select("set_id", "component_id", "holder")
    copies = sketches.groupBy("set_id").agg(F.count("*").alias("n"))
    common = hot_keys(copies, "set_id", SMALL_ROWS, sketches.count())
    rows = sketches.select("doc_id", "n_shingles", "set_id")
    lone = copies.join(placed, "set_id", "left").select("set_id", "component_id", "holder")
    return join_spread(rows, lone, "set_id", common).select(
        "doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("holder", "set_id").alias("holder")
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False))
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@lean
def _with_set_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [d for _, d in shingle_sets(*kernels.text_buffers(batch.column("text")))]
        yield batch.drop_columns(["text"]).append_column("set_id", pa.array(ids, pa.binary()))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each group: one with the smallest doc_id and the
    text that stands for the group.

    Rows of one doc_id and different texts are judged by their own texts. Rows
    without a doc_id can't be told apart by one, and stay."""
    found = _grouped(docs.select("doc_id", "text"), percent).where("doc_id IS NOT NULL")
    stays = (F.col("component_id") == F.col("doc_id")) & (F.col("holder") == F.col("set_id"))
    verdicts = found.select(F.col("doc_id").alias("id"), "set_id", stays.alias("stays")).checkpoint()
    ids = verdicts.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays")).checkpoint()

    def matching(which: str, how: str) -> DataFrame:
        some = ids.where(which).select("id").alias("x")
        some = F.broadcast(some) if ids.where(which).count() <= BROADCAST_IDS else some
        return docs.alias("d").join(some, F.col("d.doc_id") == F.col("x.id"), how)

    left = matching("n > 1 OR NOT stays", "left_anti")
    if ids.where("n > 1 AND stays").isEmpty():
        return left
    # rows of repeated ids, with their sets, against the verdicts on these
    again = matching("n > 1 AND stays", "left_semi")
    keyed = again.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = nullable(keyed.schema["row"].dataType)
    keyed = keyed.withColumn("row", F.col("row").cast(row))
    schema = T.StructType().add("id", "long").add("row", row).add("set_id", "binary")
    own = keyed.mapInArrow(_with_set_id, schema).join(verdicts.where("stays").select("id", "set_id").distinct(), ["id", "set_id"])
    one = own.dropDuplicates(["id", "set_id"])
    return left.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
