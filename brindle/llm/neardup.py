"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives every shingle a random permutation of the signature's places
and a fractional rank; a place keeps the least of (step in the permutation +
rank) over all shingles. Steps are taken for all shingles of a block of texts at
once, and a text leaves as soon as its largest place is below the next step
(early stopping), so long texts take one or two steps.

Documents with equal shingle sets are one class, represented by the smallest id;
only classes are banded, so copies cost one row each. BANDS bands of BAND_ROWS
places lose a pair at the threshold of 0.8 with a chance of about 1e-5, and far
less above it, while texts that share only a passage rarely meet. In a bucket,
classes are first compared with the bucket's head and joined into components;
after that, only classes of different components are compared, so a bucket of
near copies costs one comparison each and not one for each pair. In a large
bucket, the shingles that no other class has give an exact bound on what a class
can share, which rules out most of what the head has not joined (copies with too
many edits of their own), and what is left is compared in blocks. Links are
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import discard, hinted, kept, salted, table, tidy, unused, written

BANDS, BAND_ROWS = 64, 8
WORDS, PERCENT = 5, 80
#: Words of a block of texts that are hashed and sketched together.
BLOCK = 1 << 18
#: Comparisons with one class that share a task.
SPREAD = 256
#: Classes in more than SPREAD pairs that are broadcast at most.
HOT_AT_ONCE = 200_000
#: Classes from which a bucket is large, and shingles of a part when the private ones are counted.
CROWD, PART = 32, 1 << 21


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of anything but ASCII white space, with A to Z lower-cased, in order; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words, from the words' hashes; of a shorter text, the one of all its words."""
    if not len(h):
        return np.empty(0, np.uint64)
    width = min(words, len(h))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * _ODD[1] + h[i : i + n]
    total = _mix(total ^ np.uint64(width))
    return np.unique(total)


def _words(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The word hashes of each row of a batch, without copies."""
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def superminhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures (texts x places, a power of two) of 64-bit floats; empty sets keep infinity in all places.

    An element's permutation is a bijection of the places with three multipliers
    of its own, so it needs no table and a step costs the same for any text.
    """
    if places & (places - 1):
        raise ValueError("places must be a power of two")
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), places), np.inf)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    mask, half = np.uint32(places - 1), np.uint32(places.bit_length() // 2)
    state = np.concatenate([sets[i] for i in live])
    row = np.repeat(live, sizes[live])
    own = _mix(state ^ _ODD[3])
    start, by, then = own.astype(np.uint32), (own >> np.uint64(20)).astype(np.uint32) | np.uint32(1), (own >> np.uint64(40)).astype(np.uint32) | np.uint32(1)
    flat = out.reshape(-1)
    for step in range(places):
        state = _mix(state + _ODD[0])
        place = start + by * np.uint32(step) & mask
        place = (place ^ place >> half) * then & mask
        np.minimum.at(flat, row * places + place, step + (state >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        done = out[live].max(1) < step + 1
        if done.any():
            live = live[~done]
            if not len(live):
                break
            going = np.zeros(len(sets), bool)
            going[live] = True
            stay = going[row]
            state, row, start, by, then = state[stay], row[stay], start[stay], by[stay], then[stay]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    values = (signatures * 2.0**40).astype(np.uint64) if np.isfinite(signatures).all() else np.where(np.isfinite(signatures), signatures * 2.0**40, 2.0**60).astype(np.uint64)
    values = values.reshape(len(signatures), bands, rows)
    total = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), values.shape[:2]).copy()
    for i in range(rows):
        total = _mix(total * _ODD[2] + values[:, :, i])
    return total


def _print_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, sets = 0, 0, []
            for i, h in enumerate(_words(batch.column(1))):
                sets.append(shingles(h, words))
                held += len(sets[-1])
                if held >= BLOCK or len(sets) >= 2048 or i + 1 == batch.num_rows:
                    keys = band_keys(superminhash(sets, bands * rows), bands, rows).view(np.int64)
                    offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                        ["id", "n_shingles", "print", "keys"],
                    )
                    start, held, sets = i + 1, 0, []

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h in enumerate(_words(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([shingles(h, words).tobytes()], pa.binary())], ["id", "set"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _private_parts(parts: int):
    """Sets to rows (part, owners, hashes): a batch's shingles by part; one that several have comes once, without an owner (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            if not sets:
                continue
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            hashes, first, counts = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            owners = np.where(counts > 1, -1, owners[first])
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for k in range(parts):
                at = order[bounds[k] : bounds[k + 1]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([owners[at].tobytes()], pa.binary()), pa.array([hashes[at].tobytes()], pa.binary())], ["part", "owners", "hashes"])

    return run


def _private_of_part(rows: pa.Table) -> pa.Table:
    owners = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("owners")])
    hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")])
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    alone = owners[first[counts == 1]]
    ids, n = np.unique(alone[alone >= 0], return_counts=True)
    return pa.table({"id": pa.array(ids, pa.int64()), "private": pa.array(n, pa.int64())})


def private_shingles(sets: DataFrame, total: int) -> DataFrame:
    """Rows (id, private): how many shingles of a set none of the others has; sets without one are left out.

    The shingles (total of them) are dealt by hash into parts of a bounded size.
    One that very many sets share is sent once for each batch of sets.
    """
    parts = max(1, -(-total // PART))
    found = sets.mapInArrow(_private_parts(parts), "part bigint, owners binary, hashes binary").groupBy("part").applyInArrow(_private_of_part, "id bigint, private bigint")
    return found.groupBy("id").agg(F.sum("private").alias("private"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough.

    b may be in very many pairs: its set is sent once for each SPREAD of them.
    """
    shares = pairs.groupBy("b").agg(F.expr(f"bigint(ceil(count(*) / {SPREAD}))").alias("shares"))
    centres = sets.join(shares, sets.id == shares.b).select("b", F.col("set").alias("set_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "shares")
    # few are in more than SPREAD pairs, so pairs find their share without being dealt by b
    hot = hinted(kept(shares.where("shares > 1")), HOT_AT_ONCE)
    dealt = pairs.join(hot, "b", "left").withColumn("share", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1)))).drop("shares")
    members = dealt.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = members.join(centres.drop("shares"), ["b", "share"]).select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_confirmed(percent), "a bigint, b bigint")


def _linked_in_block(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, parts = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        sizes = np.array([len(x) for x in sets])
        told = np.flatnonzero(~asks)
        a, b = [], []
        if len(told) and asks.any():
            hashes = np.concatenate([sets[i] for i in told])
            order = np.argsort(hashes, kind="stable")
            owner, hashes = np.repeat(np.arange(len(told)), sizes[told])[order], hashes[order]
            for i in np.flatnonzero(asks):
                first, behind = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
                counts = behind - first
                at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=len(told))
                good = (100 * common >= percent * (sizes[i] + sizes[told] - common)) & (parts[told] != parts[i])
                b.append(ids[told[good]])
                a.append(np.full(good.sum(), ids[i]))
        empty = np.empty(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([empty, *a]), pa.int64()), "b": pa.array(np.concatenate([empty, *b]), pa.int64())})

    return run


def linked_in_crowds(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components in each band: members has band, id, n, component.

    All that are not in a band's largest component are asked against all of the
    band. Both sides are cut into blocks by their shingles, and two blocks meet in
    one task, so no pair is written down but the links.
    """
    per = members.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("band").agg(F.max(F.struct("c", F.col("component").alias("main"), "s")).alias("top"), F.sum("s").alias("s"))
    blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / BLOCK)
    per = per.select("band", "top.main", blocks(F.col("s")).alias("told_blocks"), blocks(F.col("s") - F.col("top.s")).alias("asking_blocks"))
    # a band may have a third of all rows, so its row here is dealt to several tasks
    rows = salted(members, per, "band", "id")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    asking = rows.where(F.col("component") != F.col("main")).select("band", "id", "component", F.lit(True).alias("asks"), own(F.col("asking_blocks")).alias("x"), copies(F.col("told_blocks")).alias("y"))
    told = rows.select("band", "id", "component", F.lit(False).alias("asks"), copies(F.col("asking_blocks")).alias("x"), own(F.col("told_blocks")).alias("y"))
    dealt = asking.unionByName(told).join(sets, "id")
    return dealt.groupBy("band", "x", "y").applyInArrow(_linked_in_block(percent), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in edges (a, b): union-find by large and small stars.

    Every id is hung on the least id near it, in turn among its larger and its
    smaller neighbours, until no edge changes. A hot id's edges are only summed
    (min) before a shuffle and never gathered: ids in more than SPREAD edges are
    few, and meet their edges where those are.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hot = kept(least.where(F.col("n") > SPREAD).select("u", F.col("m").alias("top")))
        upper = both.where("v > u").join(hinted(hot, HOT_AT_ONCE), "u", "left")
        rest = upper.where("top is null").join(least.where(F.col("n") <= SPREAD), "u")
        large = upper.where("top is not null").select("v", F.col("top").alias("m")).union(rest.select("v", "m")).toDF("u", "v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.toDF("u", "v")).distinct()
        last, edges = edges, kept(small)
        discard(last, hot)
        # two runs of the loop that end in the same edges have reached the stars
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def grouped(rows: DataFrame, key: str, text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (id, n_shingles, component) for every row of rows, whose keys must be unique whole numbers; component is its smallest id.

    Words are runs of anything but ASCII white space, with A to Z lower-cased.
    A text of fewer words is one shingle; a null or empty one has an empty set
    and is linked with nothing, so it is its own component. Equal texts are
    always linked.
    """
    tidy(rows.sparkSession)
    found = _grouped(rows, key, text, words, percent, bands, band_rows)
    # all that the result came from is done with, and its files can go before the next step needs the disk
    tidy(rows.sparkSession)
    return found


def _grouped(rows: DataFrame, key: str, text: str, words: int, percent: int, bands: int, band_rows: int) -> DataFrame:
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    hashed = lambda r: r.select("id", word_hashes(F.col("text")).alias("words"))
    sketch = written(hashed(rows).mapInArrow(_sketch(words, bands, band_rows), "id bigint, n_shingles bigint, print binary, keys array<bigint>"), "sketch")

    # classes of equal sets; a bucket is worth a look only if two classes are in it
    classes = kept(sketch.where("n_shingles > 0").groupBy("print").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n")))
    banded = sketch.where("n_shingles > 0").join(classes.select("id", "n"), "id").select("id", "n", F.explode("keys").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("in_band")).where("in_band > 1")
    buckets = written(banded.join(shared, "band").select("band", "id", "n", "in_band"), "buckets")
    sets = written(hashed(rows.join(buckets.select("id").distinct(), "id", "left_semi")).mapInArrow(_sets(words), "id bigint, set binary"), "sets")

    tidy(rows.sparkSession)

    # in a large bucket, shingles that no other class of a large bucket has bound what a class can share with any of them
    crowd = kept(buckets.where(F.col("in_band") >= CROWD).select("id", "n").distinct())
    total = crowd.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    private = kept(private_shingles(sets.join(crowd, "id", "left_semi"), total))
    bound = F.when(F.col("in_band") >= CROWD, F.coalesce("private", F.lit(0))).otherwise(0)
    # a set that is at least as similar as asked has at most reach shingles
    reach = F.floor(((100 + percent) * (F.col("n") - F.col("private")) - percent * F.col("n")) / percent)
    members = buckets.join(private, "id", "left").withColumn("private", bound).withColumn("reach", reach).withColumn("crowd", F.col("in_band") >= CROWD).drop("in_band")
    possible = lambda x, y: (F.col(f"{x}.n") <= F.col(f"{y}.reach")) & (F.col(f"{y}.n") <= F.col(f"{x}.reach")) & (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n"))

    # the head of a bucket is its class with the least share of private shingles: edited copies differ least from it
    heads = members.groupBy("band").agg(F.min(F.struct((F.col("private") / F.col("n")).alias("share"), "id", "n", "reach")).alias("head")).select("band", "head.*")
    stars = members.alias("m").join(heads.alias("h"), "band").where((F.col("m.id") != F.col("h.id")) & possible("m", "h"))
    stars = kept(stars.select(F.col("m.id").alias("a"), F.col("h.id").alias("b")).distinct())
    tidy(rows.sparkSession)
    links = kept(confirm(stars, sets, percent))
    tidy(rows.sparkSession)
    joined = components(links)
    tidy(rows.sparkSession)

    # what a bucket's head has not joined: classes of different components that share a bucket
    placed = members.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).where("x <> y").select("band", "least")
    unjoined = kept(placed.join(mixed, "band").where(F.col("least") <= F.col("reach")).select("band", "id", "n", "reach", "crowd", "component"))
    few = unjoined.where(~F.col("crowd"))
    rest = few.alias("l").join(few.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.component") < F.col("r.component")) & possible("l", "r"))
    rest = rest.select(F.greatest("l.id", "r.id").alias("a"), F.least("l.id", "r.id").alias("b")).distinct()
    tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = confirm(kept(rest.join(tried, ["a", "b"], "left_anti")), sets, percent)
    more = kept(more.union(linked_in_crowds(unjoined.where("crowd"), sets, percent)))
    tidy(rows.sparkSession)
    if not more.isEmpty():
        joined = components(links.union(more))

    found = sketch.select("id", "n_shingles", "print").join(classes.select("print", F.col("id").alias("head")), "print", "left")
    found = found.join(joined.withColumnRenamed("id", "head"), "head", "left")
    found = found.select("id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("head")), "id").alias("component"))
    # three numbers a row stay; the sketches and sets they come from go
    found = written(found, "components")
    discard(sketch, buckets, sets, classes, crowd, private, stars, links, unjoined, more)
    return found


def numbered(docs: DataFrame, key: str, row: str) -> tuple[DataFrame, bool]:
    """docs with a unique column row: the key (true), or where some key is null, repeated or no integer, a number written with the rows (false)."""
    integer = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if integer and docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(row, F.col(key).cast("long")), True
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), False


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept) for every row of docs; see grouped().

    component_id is the smallest key that is linked with the row. Rows of equal
    keys are told apart by their texts; those with a null key are documents too,
    and a group of nothing but such rows has a null component_id and keeps its
    first one. Rows with a key are kept if it is the component's.
    """
    row = unused("row", docs)
    rows, same = numbered(docs.select(key, text), key, row)
    found = grouped(rows, row, text, words, percent, bands, band_rows)
    if same:
        return found.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    named = kept(found.join(rows.select(F.col(row).alias("id"), F.col(key).alias("own")), "id"))
    parts = named.groupBy("component").agg(F.min("own").alias("component_id"), F.min("id").alias("first"))
    named = salted(named, parts, "component", "id")
    keep = F.coalesce(F.col("own") == F.col("component_id"), F.col("component_id").isNull() & (F.col("id") == F.col("first")))
    return named.select(F.col("own").alias(key), "n_shingles", "component_id", keep.alias("kept"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one row of each component stays, the one with the smallest id; rows with a null id are documents too and come last."""
    row = unused("row", docs)
    rows, _ = numbered(docs, "doc_id", row)
    found = grouped(rows, row).select(F.col("id").alias(row), "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    keep = rows.select(row, "doc_id").join(found, row).groupBy("component").agg(first).select(F.col(f"first.{row}").alias(row))
    return rows.join(keep, row, "left_semi").select(docs.columns)


QUERIES = {"op5_superminhash": op5_superminhash}
