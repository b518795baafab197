"""Near-duplicate documents by min-max hashing.

Both the minimum and the maximum under each permutation are kept, so a signature
of 128 values costs 64 hash evaluations for each shingle.  Bands of two minima and
two maxima name the buckets.  With 32 bands a pair of similarity 0.75 shares no
bucket with a probability of 5e-6, a pair of 0.8 with one of 5e-8.

Documents of equal shingle sets form one class, and only classes go on, so groups
of copies cost one row.  In a bucket, classes are first compared with a pivot, the
class of most copies; the links found so far make components.  Only buckets that
still hold several components need more.  In small ones the pairs across components are
compared.  The classes of large ones are joined on their rarest shingles instead, an exact
prefix filter: classes of similar size and at least the similarity wanted must share
one of these, so no link is lost and no pairs of a large group are listed.  Every
link is confirmed on full shingle sets.

Shingles: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, five to a shingle, as
64-bit hashes.  A text of fewer words is one shingle; a text without words has none
and is linked with nothing.  Rows with a null id are linked with nothing and kept.
Rows with equal ids are judged by their own texts.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep, remove
from tallowick.operators.components import connected_components

PERMUTATIONS, ROWS, SIZE = 64, 4, 5
#: a bucket of more classes than this goes to the prefix join
SMALL_BUCKET = 24
#: 64-bit words of the parity bitmap by which the prefix join bounds how far two sets differ
PARITY_WORDS = 8
#: of at most so many shared elements, the prefix join sends the table to the sets instead of the sets to it
LOOKUP_MOST = 1 << 20
#: bits for each class in the filter that picks documents, and the filter's least and largest size
FILTER_RATE, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 27


def signatures(gram: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 5) -> np.ndarray:
    """Per set, the minimum and the maximum under each permutation side by side; empty sets get zeros."""
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        factors, shifts = K.seeds(permutations, seed) | np.uint64(1), K.seeds(permutations, seed + 1)
        at = bounds[full]
        for i in range(permutations):
            # The low bits of a product are poor; the high half decides.
            x = (gram * factors[i] + shifts[i]) >> np.uint64(32)
            out[full, 2 * i], out[full, 2 * i + 1] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` neighbouring signature values, different between bands."""
    n, width = signature.shape
    bands = width // rows
    turn = K.seeds(rows, 31) | np.uint64(1)
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    return K.mix((parts * turn).sum(2, dtype=np.uint64) + K.seeds(bands, 32))


def _set_keys(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw = gram.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j], seed=j - i) if j > i else 0 for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], size: int, permutations: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces(batch, "text"):
            gram, bounds = K.shingles(part.column("text"), size)
            bands = band_keys(signatures(gram, bounds, permutations), rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds)), pa.array(_set_keys(gram, bounds).view(np.int64)), _lists(bands.reshape(-1), np.arange(len(bands) + 1) * bands.shape[1])], ["id", "n", "node", "bands"])


def _wanted(node: np.ndarray, row_id: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = K.mix(node.view(np.uint64) ^ K.mix(row_id.view(np.uint64)))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of 65,536 bits of a Bloom filter of the rows' (node, id)."""
    for batch in batches:
        at = np.unique(np.concatenate(_wanted(batch.column("node").to_numpy(), batch.column("id").to_numpy(), bits)))
        for block in np.unique(at >> 16):
            flags = np.zeros(1 << 16, bool)
            flags[at[np.searchsorted(at, block << 16) : np.searchsorted(at, (block + 1) << 16)] & 0xFFFF] = True
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(flags).tobytes()])], ["block", "bits"])


def _or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            new = np.frombuffer(bits, np.uint8)
            held[block] = held[block] | new if block in held else new
    for block, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], ["block", "bits"])


def _sets(batches: Iterator[pa.RecordBatch], shared, bits: int, size: int) -> Iterator[pa.RecordBatch]:
    packed = shared.value
    for batch in batches:
        for part in K.pieces(batch, "text"):
            gram, bounds = K.shingles(part.column("text"), size)
            node, row_id = _set_keys(gram, bounds).view(np.int64), part.column("id").to_numpy(zero_copy_only=False)
            a, b = _wanted(node, row_id, bits)
            hit = np.flatnonzero(K.bit_set(packed, a) & K.bit_set(packed, b) & (np.diff(bounds) > 0))
            if len(hit):
                grams = [gram[bounds[i] : bounds[i + 1]] for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(row_id[hit]), pa.array(node[hit]), _lists(np.concatenate(grams), np.cumsum([0, *map(len, grams)]))], ["id", "node", "grams"])


def sets_of(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, grams`` for the classes in ``nodes`` (``node, id``), each from its document of that id.

    A Bloom filter of ``FILTER_MOST`` bits at most picks the documents while the texts are read
    again, so texts are not shuffled; what it lets through in error joins with nothing.
    """
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_RATE * max(1, nodes.count()) - 1).bit_length()))
    merged = nodes.select("node", "id").mapInArrow(lambda x: _mark(x, bits), "block int, bits binary").repartition("block").mapInArrow(_or, "block int, bits binary")
    out = np.zeros((bits >> 16, 8192), np.uint8)
    for r in merged.collect():  # bits / 8 bytes in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(out.reshape(-1))
    found = rows.filter("id is not null").mapInArrow(lambda x: _sets(x, shared, bits, size), "id long, node long, grams array<long>")
    return keep(found.dropDuplicates(["node"]).select("node", "grams"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` with at least ``percent`` % similarity on full sets."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    shared = both.select("u", "v", F.size("gu").alias("nu"), F.size("gv").alias("nv"), F.size(F.array_intersect("gu", "gv")).alias("both"))
    return shared.filter(100 * F.col("both") >= percent * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``label``: the component of ``node``, itself where no link reaches it."""
    return rows.join(connected_components(links, "u", "v"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _parity(token: str) -> list[F.Column]:
    """For each bit of the bitmap, whether an odd number of a group's tokens falls on it."""
    place = F.shiftrightunsigned(F.xxhash64(token), 32) % (64 * PARITY_WORDS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return [F.coalesce(F.bit_xor(F.when(F.floor(place / 64) == i, bit)), F.lit(0)).alias(f"parity{i}") for i in range(PARITY_WORDS)]


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, token, n``: in how many sets of each label an element stands, summed up for each batch."""
    for batch in batches:
        column = batch.column("grams")
        bounds = np.asarray(column.offsets).astype(np.int64)
        label, of = np.unique(np.repeat(batch.column("label").to_numpy(), np.diff(bounds)), return_inverse=True)
        token, at = np.unique(column.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True)
        pair, n = np.unique(of.astype(np.int64) * max(1, len(token)) + at, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(label[pair // max(1, len(token))], pa.int64()), pa.array(token[pair % max(1, len(token))], pa.int64()), pa.array(n, pa.int64())], ["label", "token", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each set's shared elements, the rarest first, and the parities of its bitmap."""
    tokens, df = shared.value
    for batch in batches:
        column, rows = batch.column("grams"), batch.num_rows
        bounds = np.asarray(column.offsets).astype(np.int64)
        value, of = column.values.to_numpy()[bounds[0] : bounds[-1]], np.repeat(np.arange(rows), np.diff(bounds))
        at = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
        hit = tokens[at] == value
        value, of, n = value[hit], of[hit], df[at[hit]]
        order = np.lexsort((value, n, of))
        place = (K.mix(value.view(np.uint64)) >> np.uint64(32)) % np.uint64(64 * PARITY_WORDS)
        parity = np.zeros((rows, PARITY_WORDS), np.uint64)
        np.bitwise_xor.at(parity, (of, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        pairs = pa.StructArray.from_arrays([pa.array(n[order], pa.int64()), pa.array(value[order], pa.int64())], ["df", "token"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), pa.array(np.diff(bounds).astype(np.int32)), lists, *(pa.array(p.view(np.int64)) for p in parity.T.copy())], ["node", "label", "n", "order", *(f"parity{i}" for i in range(PARITY_WORDS))])


def _prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of differently labelled classes that may be similar, by an exact prefix filter.

    Sets of sizes a <= b are similar only if they share at least t / (1 + t) * (a + b)
    elements, which is at least 2 * t / (1 + t) * a and at least t * b.  The rarest element
    they share then stands early in both: a set is found under its first elements, fewer
    when it is the smaller one, more when it is the larger one.  The elements that follow
    the shared one bound the overlap, so the join drops pairs that can't reach it; so do
    bitmaps of the parity of the elements that fall on each bit, as two sets differ in at
    least as many elements as their bitmaps in bits.
    Only elements found under several labels can be shared by the sets of such a pair, so
    the others are left out before, and prefixes are taken of what is left.
    """
    t = percent / 100
    overlap = lambda n: F.ceil(F.lit(t / (1 + t)) * n - 1e-6)
    own = sets.join(labels.select("node", "label"), "node").select("node", "label", "grams")
    counted = own.select("label", "grams").mapInArrow(_label_counts, "label long, token long, n long")
    spread = keep(counted.groupBy("token").agg(F.sum("n").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token", "df"), "spread")
    found = spread.count()
    if not found:
        return sets.sparkSession.createDataFrame([], "u long, v long")
    if found <= LOOKUP_MOST:
        table = spread.toPandas().sort_values("token")  # LOOKUP_MOST rows at most
        shared = sets.sparkSession.sparkContext.broadcast((table["token"].to_numpy(np.int64), table["df"].to_numpy(np.int64)))
        ranked = own.mapInArrow(lambda x: _looked_up(x, shared), "node long, label long, n int, order array<struct<df:long,token:long>>, " + ", ".join(f"parity{i} long" for i in range(PARITY_WORDS)))
    else:
        token = own.select("node", "label", F.size("grams").alias("n"), F.explode("grams").alias("token"))
        ranked = token.join(spread, "token").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"), *_parity("token"))
    marks = [f"parity{i}" for i in range(PARITY_WORDS)]
    as_larger = F.size("order") - F.greatest(F.lit(1), F.ceil(F.lit(t) * F.col("n") - 1e-6)) + 1
    as_smaller = F.size("order") - F.greatest(F.lit(1), overlap(2 * F.col("n"))) + 1
    prefix = ranked.withColumns({"length": F.greatest(F.lit(0), as_larger).cast("int"), "short": as_smaller})
    each = prefix.filter("length > 0").select("node", "label", "n", "short", *marks, F.size("order").alias("m"), F.posexplode(F.slice("order", F.lit(1), F.col("length"))).alias("at", "x"))
    keyed = each.select("node", "label", "n", "m", *marks, F.col("x.token").alias("token"), (F.col("m") - F.col("at")).alias("rest"), (F.col("at") < F.col("short")).alias("small"))
    # A token that is in prefixes of one component only links nothing new.
    mixed = keyed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    keyed = keep(keyed.join(mixed, "token", "left_semi"), "prefix")
    a, b = keyed.filter("small").alias("a"), keyed.alias("b")
    of = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    need = overlap(sum(of("n")))
    differ = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in map(of, marks))
    smaller = F.struct("a.n", "a.node") < F.struct("b.n", "b.node")
    may = smaller & (F.col("a.label") != F.col("b.label")) & (F.least(*of("rest")) >= need) & (sum(of("m")) - differ >= 2 * need)
    return _ordered(a.join(b, (F.col("a.token") == F.col("b.token")) & may).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = SIZE, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = keep(texts.mapInArrow(lambda x: _sign(x, size, permutations, rows), "id long, n long, node long, bands array<long>"), "signed")
    live = signed.filter("n > 0 and id is not null")
    classes = live.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.any_value("bands").alias("bands"))
    buckets = keep(classes.select("node", "copies", "id", F.explode("bands").alias("bucket")), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct(-F.col("copies"), "node")).alias("pivot")).filter("members > 1")
    member = keep(buckets.join(shared.select("bucket", "members", F.col("pivot.node").alias("pivot")), "bucket"), "members")
    remove(buckets)
    sets = sets_of(texts, keep(member.select("node", "id").distinct(), "wanted"), size)
    links = keep(confirmed(_ordered(member.select(F.col("pivot").alias("u"), F.col("node").alias("v"))), sets, percent), "links")
    # Buckets that hold several components still may hide links between them.
    labelled = keep(_labelled(member, links), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    open_rows = keep(labelled.filter("members > 2").join(mixed, "bucket", "left_semi"), "open")
    small = open_rows.filter(F.col("members") <= SMALL_BUCKET).select("bucket", "node", "label", "pivot")
    a, b = (small.filter("node <> pivot").select("bucket", F.col("node").alias(x), F.col("label").alias(y)) for x, y in (("u", "lu"), ("v", "lv")))
    pairs = _ordered(a.join(b, "bucket").filter("u < v and lu <> lv"))
    large = keep(open_rows.filter(F.col("members") > SMALL_BUCKET).select("node", "label").distinct(), "large")
    if not large.isEmpty():
        pairs = pairs.union(_prefix_pairs(sets.join(large.select("node"), "node", "left_semi"), large, percent)).distinct()
    links = keep(links.union(confirmed(pairs, sets, percent)), "links")
    lead = connected_components(links, "u", "v").join(classes.select("node", "id"), "node")
    smallest = lead.groupBy("component").agg(F.min("id").alias("smallest"))
    of = lead.select("node", "component").join(smallest, "component").select("node", "smallest")
    # Classes without a link are led by their own smallest id.
    own = classes.select("node", F.col("id").alias("own"))
    out = signed.join(own, "node", "left").join(of, "node", "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    component = F.when(linked, F.least("own", F.coalesce("smallest", "own"))).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
