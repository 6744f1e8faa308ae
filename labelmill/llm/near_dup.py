"""Near-duplicate detection by b-bit MinHash.

1. Each text gives its set of word shingles, a 128-bit fingerprint of that set, the minima of HASHES hash functions,
   the low BITS bits of the minima packed into a signature, and BANDS band keys over the whole minima. This table is
   written once.
2. Rows with equal fingerprints are one class, represented by the smallest id; only representatives go on.
3. In every band bucket one leader (the member found in most company) is paired with the others. A pair is a
   candidate if the collision-corrected similarity, estimated from the bit counts of the signatures, doesn't rule the
   threshold out. Candidates are confirmed on the full sets, and links are joined into components.
4. Representatives in buckets that still hold several components are left open. Links between components of these are
   found from their full sets. With shingles in the order of how few open sets have them, two sets that are similar
   enough share one among the first few of each. Where that is a rare one, sets are paired by it. Sets with common ones
   there, as those that are put together from the same parts, are paired by bands over other minima, if enough stands from
   the first shingle on that both prefixes have. In either case a pair is only made if the labels differ and the
   collision-corrected similarity of one-bit signatures allows it, as part of the join's condition. A link is missed with
   a probability of MISS, whatever leaders were chosen.

What belongs to a bucket is joined to its members by broadcast where it has many, and by shuffle where it has
few, so no task gets all members of a large one. Nothing is collected to the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import SPACED, mix, row_groups, text_bytes, windows, words
from labelmill.llm.shared import bounded_batches, fits_broadcast, scratch, staged, tidy

SHINGLE = 5
HASHES = 192
BANDS = 32
BITS = 4
#: Buckets with more members than this are joined by broadcast, the MANY largest of them at most.
FEW_MEMBERS = 256
MANY = 1 << 16
#: How likely a pair at the threshold agrees in a finer band, which sets the rows of a band, and shares none of all bands.
FINE = 0.377
MISS = 1e-7
#: Minima that finer pairs are judged by, one bit of each.
FINE_BITS = 1024
#: A shingle that more prefixes have than this is a common one.
RARE = 64
#: An estimate this much below the threshold (about five standard errors) rules a pair out.
SLACK = 0.16


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text of fewer words is one shingle, one without words has none."""
    hashes, rows, _, _ = words(data, offsets, SPACED, lower=True)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    keys, _ = windows(hashes, rows, SHINGLE)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            yield np.unique(keys[a : b - SHINGLE + 1])
        elif b > a:
            yield windows(hashes[a:b], rows[a:b], int(b - a))[0] + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def _functions(n: int, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """What n hash functions add and multiply by; others for another first."""
    seeds = mix(np.arange(first, first + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32)[:, None], ((seeds[n:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


def minima(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The smallest value that each hash function takes on the set."""
    xor, multiply = functions or (_XOR, _MULTIPLY)
    folded = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(folded), 1024):
        np.minimum(least, (((folded[None, lo : lo + 1024] ^ xor) * multiply)).min(axis=1), out=least)
    return least


_XOR, _MULTIPLY = _functions(HASHES)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 // BITS to a long."""
    low = (mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = least.reshape(bands, len(least) // bands).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return keys


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity estimated from two arrays of signatures, corrected for low bits that agree by chance."""
    x = a ^ b
    for shift in (1 << k for k in range(BITS.bit_length() - 1)):
        x = x | (x >> np.uint64(shift))
    x &= np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    agree = 1.0 - np.bitwise_count(x).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1.0 - chance)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, sig, bands): set size, fingerprint, packed signature and band keys of each row; the last four are null for an empty set."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                n, f1, f2, sig, bands = [], [], [], [], []
                for s in shingle_sets(data, offsets[lo : hi + 1]):
                    n.append(len(s))
                    if not len(s):
                        f1.append(None), f2.append(None), sig.append(None), bands.append(None)
                        continue
                    f1.append(int(_signed(mix(np.array([s.sum(dtype=np.uint64)])))[0]))
                    f2.append(int(_signed(mix(np.array([np.bitwise_xor.reduce(mix(s))])))[0]))
                    least = minima(s)
                    sig.append(packed(least).tobytes())
                    bands.append(_signed(band_keys(least)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema)


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b, na, nb, sa, sb) those that sizes and signatures don't rule out, as (a, b)."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(estimated(sa, sb) >= threshold - SLACK))

    sized = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9))
    return sized.select("a", "b", "sa", "sb").mapInArrow(tidy(run), schema)


def _full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set): the full shingle sets of the texts of the wanted ids, a table in the shared folder."""
    wanted = staged(wanted.distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if fits_broadcast(wanted, "id") else wanted, "id", "left_semi")
    schema = T.StructType([docs.schema["id"], T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(data, offsets[lo : hi + 1])], pa.binary())], names=["id", "set"])

    return staged(texts.select("id", "text").mapInArrow(tidy(run), schema), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids those with 100 * intersection >= percent * union on their full sets. docs: (id, text)."""
    kind = pairs.schema["a"].dataType

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            if keep:
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    full = _full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs)
    left, right = full.toDF("a", "set_a"), full.toDF("b", "set_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(compare), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _attached(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts (key, size, ...) of their key. The MANY largest of those with a size over FEW_MEMBERS are sent to all executors."""
    few = _few(facts)
    if facts.where(F.col("size") > few).isEmpty():
        return rows.join(facts, key)
    large = F.broadcast(facts.where(F.col("size") > few))
    small = rows.join(F.broadcast(facts.where(F.col("size") > few).select(key)), key, "left_anti").join(facts.where(F.col("size") <= few), key)
    return rows.join(large, key).unionByName(small)


def _few(facts: DataFrame) -> int:
    """The size over which keys are sent: FEW_MEMBERS, or more if over MANY keys are as large. Sizes are counted by powers of two, so what is known of them is small however many keys there are."""
    counts = {r["power"]: r["n"] for r in facts.where(F.col("size") > FEW_MEMBERS).groupBy(F.floor(F.log2("size")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    few, sent = FEW_MEMBERS, sum(counts.values())
    for power in sorted(counts):
        if sent <= MANY:
            break
        few, sent = (2 << power) - 1, sent - counts[power]
    return few


def _prefixes(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(id, n, label, rest, shingle, short, size): the shingles in the prefixes of sets (id, set) that stand in prefixes of several labels, and in how many.

    If 100 * intersection >= percent * union and b isn't the larger set, the intersection has at least percent / 100 of a,
    and 2 * percent / (100 + percent) of b. So of either set only the rarest others + 1 shingles matter. What stands before
    the first shingle that two sets share isn't in their intersection, so a pair needn't be made where too little stands from there on.
    """
    kind = sets.schema["id"].dataType

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                values = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                sizes = np.array([len(v) for v in values], np.int64)
                at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))], names=["id", "n", "shingle"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("shingle", T.LongType())])
    each = staged(sets.mapInArrow(tidy(exploded), schema), "shingles")
    counts = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shingle-counts")
    common = _attached(each, counts, "shingle")
    # what only one set has comes first and is never shared: the rest stands behind it
    listed = common.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("size", "shingle"))).alias("common"))
    least_a = F.ceil(F.col("n") * percent / 100 - 1e-9)
    least_b = F.ceil(F.col("n") * 2 * percent / (100 + percent) - 1e-9)
    alone = F.col("n") - F.size("common")
    placed = listed.join(label, "id").withColumn("as_a", (F.col("n") - least_a + 1 - alone).cast("int")).withColumn("as_b", (F.col("n") - least_b + 1 - alone).cast("int"))
    prefix = placed.where("as_a > 0").select("id", "n", "label", F.size("common").alias("shared"), "as_b", F.posexplode(F.expr("slice(common, 1, least(as_a, size(common)))")).alias("at", "x"))
    # how many shingles stand from this one on
    prefix = prefix.withColumn("rest", F.col("shared") - F.col("at"))
    prefix = staged(prefix.select("id", "n", "label", "rest", F.col("x.shingle").alias("shingle"), (F.col("at") < F.col("as_b")).alias("short")), "prefixes")
    # shingles in the prefixes of one component only are left out
    mixed = prefix.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("shingle", "size")
    return staged(_attached(prefix, staged(mixed, "mixed"), "shingle"), "prefixes")


def _rare_pairs(prefix: DataFrame, facts: DataFrame, near: Callable[[], Column], percent: int) -> DataFrame:
    """Pairs (a, b) that share a rare shingle of their prefixes."""
    prefix = prefix.where(F.col("size") <= RARE).join(facts.drop("n"), "id")
    bits = [c for c in facts.columns if c.startswith("bits")]
    a = prefix.select("shingle", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("rest").alias("ra"), *(F.col(c).alias(f"a_{c}") for c in bits))
    b = prefix.where("short").select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("rest").alias("rb"), *(F.col(c).alias(f"b_{c}") for c in bits))
    smaller = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    return a.join(b, (a["shingle"] == b["shingle"]) & smaller & _enough(percent, F.least("ra", "rb")) & near()).select("a", "b")


def _enough(percent: int, most: Column) -> Column:
    """Whether sets of na and nb shingles may be similar enough if at most so many of them are in both."""
    return 100 * most >= percent * (F.col("na") + F.col("nb") - most)


def fine_bands(threshold: float) -> tuple[int, int]:
    """(bands, rows of each) that miss a pair at the threshold with a probability of MISS at most."""
    t = min(threshold, 0.99)
    rows = max(1, min(64, round(math.log(FINE) / math.log(t))))
    return math.ceil(math.log(MISS) / math.log1p(-(t**rows))), rows


def _fine_pairs(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids in sets (id, set) with different labels that may be linked: those that share a rare shingle of their prefixes, and, of sets with common ones there, those that share a finer band. Sizes and signatures that rule a pair out are part of the joins' conditions."""
    kind = sets.schema["id"].dataType
    threshold = percent / 100
    bands, rows = fine_bands(threshold)
    hashes, kept = max(bands * rows, FINE_BITS), FINE_BITS // 64
    # a bit agrees in any case half of the time: 1 - 2 h / bits estimates the similarity
    error = math.sqrt((1.0 - threshold**2) / (64 * kept))
    most_differing = math.floor((1.0 - threshold + 5.5 * error) / 2 * 64 * kept)
    bits = [f"bits{k}" for k in range(kept)]
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), *(T.StructField(c, T.LongType()) for c in bits), T.StructField("bands", T.ArrayType(T.LongType()))])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _functions(hashes, first=1 << 20)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, signs, keys = [], [], []
                for packed_set in part.column(1):
                    s = np.frombuffer(packed_set.as_py(), np.uint64)
                    least = minima(s, functions)
                    n.append(len(s))
                    signs.append(np.packbits((mix(least[: 64 * kept].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64))
                    keys.append(_signed(band_keys(least[: bands * rows], bands)))
                signs = np.array(signs, np.int64).reshape(len(n), kept)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(kept)), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    fine = staged(sets.mapInArrow(tidy(signed), schema), "fine")
    facts = fine.drop("bands")

    def near() -> Column:
        differing = F.lit(0)
        for c in bits:
            differing = differing + F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
        return (F.col("la") != F.col("lb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing <= most_differing)

    prefix = _prefixes(sets, label, percent)
    rare = _rare_pairs(prefix, facts, near, percent)
    # the shingles of the prefix in order, and how many stand from each on
    heads = prefix.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rest")).alias("at"), F.hash("shingle").alias("x")))).alias("head"), F.max("size").alias("size"))
    heads = heads.where(F.col("size") > RARE).select("id", F.transform("head", lambda h: h["x"]).alias("head"), F.transform("head", lambda h: -h["at"]).alias("rests"))
    common = staged(heads, "common")
    if common.isEmpty():
        return rare.distinct()
    each = fine.join(common, "id", "left_semi").join(label, "id").select("id", "label", F.explode("bands").alias("band"))
    # bands of one component only are left out
    mixed = each.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("band", "size")
    shared = staged(_attached(each, staged(mixed, "mixed"), "band").drop("size"), "shared").join(facts, "id").join(common, "id")
    a = shared.select("band", F.col("id").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"), F.col("rests").alias("rests_a"), F.col("label").alias("la"), *(F.col(c).alias(f"a_{c}") for c in bits))
    b = shared.select("band", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"), F.col("rests").alias("rests_b"), F.col("label").alias("lb"), *(F.col(c).alias(f"b_{c}") for c in bits))
    # prefixes must have a shingle in common, and enough must stand from the first one on; a collision of hashes can only make that more
    first = F.get(F.array_intersect("ha", "hb"), F.lit(0))
    left = [F.get(rests, (F.array_position(head, first) - 1).cast("int")) for head, rests in (("ha", "rests_a"), ("hb", "rests_b"))]
    banded = a.join(b, (a["band"] == b["band"]) & (F.col("a") < F.col("b")) & near() & _enough(percent, F.least(*left))).select("a", "b")
    return rare.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(banded).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id in links (a, b) reaches. Labels spread to neighbours and jump to their label's label until nothing changes."""
    links = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = staged(spread.join(jump, "label").select("id", "old", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("id", "label")
        labels.staged_at = moved.staged_at
        if moved.where("old <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id and kept.

    Texts are linked if 100 * intersection >= percent * union of their sets of five-word shingles (words are
    separated by white space, A-Z in lower case). component_id is the smallest id that links reach, kept says
    whether that is the row's own id. A null or empty text, or one without words, has the empty set and is linked
    with nothing. Rows that repeat an id are all given, each placed by its own text;
    where an id stands for several texts, their links join. A null id is placed
    like any other, but no row is named by it.
    Other columns of docs aren't read.
    """
    with scratch() as keep:
        bounded_batches(docs.sparkSession)
        threshold = percent / 100
        sigs = keep(staged(signatures(docs, id_col, text_col), "signatures"))
        source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        full = sigs.where("n > 0")
        classes = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"), F.min_by("bands", "id").alias("bands"))
        classes = keep(staged(classes, "classes"))

        # members of buckets of two or more, with the company each representative keeps
        member = classes.select("rep", F.explode("bands").alias("bucket"))
        sizes = staged(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        buckets = staged(_attached(member, sizes, "bucket"), "buckets")
        company = buckets.groupBy("rep").agg(F.sum("size").alias("company"))
        seated = buckets.join(company, "rep")
        leaders = staged(seated.groupBy("bucket").agg(F.max(F.struct("company", "rep"))["rep"].alias("lead"), F.max("size").alias("size")), "leaders")
        lead_pairs = _attached(buckets.drop("size"), leaders, "bucket").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
        facts = classes.select("rep", "n", "sig")

        def likely(pairs: DataFrame) -> DataFrame:
            return staged(_likely(pairs.join(facts.toDF("a", "na", "sa"), "a").join(facts.toDF("b", "nb", "sb"), "b"), threshold), "pairs")

        first = likely(lead_pairs)
        links = staged(_confirmed(first, source, percent), "confirmed")
        label = components(links)

        # what the leaders left open: members of buckets of three or more with several components
        placed = staged(buckets.where("size > 2").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label")), "placed")
        mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("bucket", "size")
        left = staged(_attached(placed, staged(mixed, "mixed"), "bucket").select(F.col("rep").alias("id"), "label").distinct(), "open")
        if not left.isEmpty():
            pairs = _fine_pairs(_full_sets(left.select("id"), source), left, percent)
            both = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
            second = likely(pairs.join(both, ["a", "b"], "left_anti"))
            if not second.isEmpty():
                label = components(links.union(staged(_confirmed(second, source, percent), "confirmed")))

        keep(label)
        named = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("label", "rep").alias("component"))
        same = (sigs["f1"] == named["f1"]) & (sigs["f2"] == named["f2"]) & (sigs["n"] == named["m"])
        out = sigs.join(named, same, "left").select(sigs["id"].alias(id_col), sigs["n"].alias("n_shingles"), F.coalesce("component", sigs["id"]).alias("component_id"))
        return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, all columns as they were; of rows that repeat id and text one stays."""
    with scratch() as keep:
        found = staged(near_duplicates(docs, id_col, text_col, percent).select(F.col(id_col).alias("found_id"), "kept"), "kept")
        gone = keep(staged(found.where(~F.col("kept")).select("found_id").distinct(), "gone"))
        out = docs.join(F.broadcast(gone) if fits_broadcast(gone, "found_id") else gone, docs[id_col].eqNullSafe(gone["found_id"]), "left_anti")
        twice = keep(staged(found.where("kept").groupBy("found_id").count().where("count > 1").select("found_id"), "twice"))
        if twice.isEmpty():
            return out
        # only rows whose id comes up again are compared
        twice = F.broadcast(twice) if fits_broadcast(twice, "found_id") else twice
        same = out[id_col].eqNullSafe(twice["found_id"])
        return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
