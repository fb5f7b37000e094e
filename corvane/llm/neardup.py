"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its distinct `k`-word shingles; equal sets are one class from the start. A class's signature has
MinHash coordinates, and every (coordinate, value) pair is a posting list. Two sets of Jaccard similarity s agree on a
coordinate with probability s, so linked classes (s >= 0.85) agree on 29 of 48 coordinates but for a chance of 1e-5, and on
90 of 128 but for 2e-5.

  screen   every class posts `screen` coordinates; one that shares fewer than `screen_match` of its pairs with any other
           has no link. What is left (near copies, in the main) is read again for its full set and `coords` coordinates.
  prefix   of the pairs that a class shares with any other, ordered by rising list length, only the first
           (shared - min_match + 1) are posted: two classes with min_match common pairs meet in at least one list.
  skip     each list is first held against its most central class (most shared pairs); confirmed links are merged into
           components. A list whose members are in one component is done. In any other, members outside the list's largest
           component are compared with all of other components, in blocks of bounded rows and bytes that are dealt out
           over tasks: a pair counts its agreeing coordinates, once, in the first list that both share, and emits a row
           only if it links two components. No list is cut.

What agrees on min_match coordinates is confirmed on the full sets. Links make components by distributed stars.

Defined cases: null texts and texts without words have an empty set, are linked with nothing and kept; equal rows are one
class, and all rows of the least id are kept; rows of equal id and different texts are linked only by their texts; a null
id never names a component unless all its ids are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .graph import components
from .shared import stage


@dataclass(frozen=True)
class Settings:
    k: int = 5
    percent: int = 85
    screen: int = 48
    screen_match: int = 29
    coords: int = 128
    min_match: int = 90
    block: int = 1024
    block_bytes: int = 1 << 24


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text, sorted, one after the other."""
    buf, offs = B.raw(texts)
    buf = B.LOWER[buf]
    starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
    h = B.span_hashes(buf, starts, ends)
    n, sizes = len(offs) - 1, np.diff(first)
    g = B.grams(h, k)
    at = np.flatnonzero(B.in_document(first, k, len(g))) if len(g) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    value, owner = [g[at]], [doc[at]]
    for size in range(1, k):  # whole sequences of shorter texts
        short = np.flatnonzero(sizes == size)
        if len(short):
            value.append(B.mix(B.grams(h, size)[first[short]] + B.U64(size)))
            owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def signatures(value: np.ndarray, at: np.ndarray, coords: int) -> np.ndarray:
    """A row of coordinate minima, mixed with the coordinate's number, for each non-empty set; others are 0."""
    out = np.zeros((len(at) - 1, coords), B.U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        keys = B.mix(np.arange(1, coords + 1, dtype=B.U64) * B.U64(0x9E3779B97F4A7C15))
        for c in range(coords):
            out[full, c] = np.minimum.reduceat((value ^ keys[c]) * (keys[c] | B.U64(1)), at[full])
        out[full] = B.mix(out[full] ^ keys)
    return out


def _digests(value: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell sets apart; None for the empty set."""
    import hashlib

    data = value.tobytes()
    return [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sign(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.text_array(batch.column(2))
            for lo, hi in B.slices(text, 1 << 20):
                value, at = shingle_sets(text.slice(lo, hi - lo), s.k)
                sig = signatures(value, at, s.screen).view(np.int64)
                part = batch.slice(lo, hi - lo)
                offs = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * s.screen)
                cols = [part.column(0), part.column(1), pa.array(np.diff(at)), pa.array(_digests(value, at), pa.binary()), pa.ListArray.from_arrays(offs, pa.array(sig.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_t", "n_shingles", "_cls", "_sig"])

    return run


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.text_array(batch.column(1))
            for lo, hi in B.slices(text, 1 << 20):
                value, at = shingle_sets(text.slice(lo, hi - lo), s.k)
                data, sig = value.tobytes(), signatures(value, at, s.coords)
                sets = pa.array([data[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.slice(lo, hi - lo).column(0), pa.array([x.tobytes() for x in sig], pa.binary()), sets], ["_cls", "_sig", "_set"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(s: Settings):
    """Pairs (a, b, signatures, sets) to those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, sets = ([[np.frombuffer(v.as_buffer(), B.U64) for v in batch.column(c)] for c in cs] for cs in ((2, 3), (4, 5)))
            ok = [int((p == q).sum()) >= s.min_match and similar(x, y, s.percent) for p, q, x, y in zip(*sig, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _compare(rows: pa.Table, s: Settings) -> list[tuple[bytes, bytes]]:
    """Links between different components of one cell: columns _tok, _i, _j, _one (is it to be compared with all others), _cls, _root, _first, _sig, _set."""
    n = rows.num_rows
    one, cls, root = rows.column(3).to_numpy(), rows.column(4).to_pylist(), rows.column(5).to_pylist()
    if one.all() or not one.any():
        return []
    number = {r: k for k, r in enumerate(dict.fromkeys(root))}
    root = np.array([number[r] for r in root])
    sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), B.U64).reshape(n, -1)
    low = (sig & B.U64(0xFF)).astype(np.uint8)
    sets = [np.frombuffer(x.as_buffer(), B.U64) for x in rows.column(8)]
    first = [set(x) for x in rows.column(6).to_pylist()]
    size = np.array([len(x) for x in sets])
    out, others = [], np.flatnonzero(~one)
    for a in np.flatnonzero(one).tolist():
        other = others[root[others] != root[a]]
        other = other[(100 * np.minimum(size[other], size[a]) >= s.percent * np.maximum(size[other], size[a]))]
        other = other[(low[other] == low[a]).sum(1) >= s.min_match]
        for b in other.tolist():
            if root[b] != root[a] and int((sig[a] == sig[b]).sum()) >= s.min_match and first[a].isdisjoint(first[b]) and similar(sets[a], sets[b], s.percent):
                out.append((cls[a], cls[b]))
                root[root == root[b]] = root[a]
    return out


def _blocks(s: Settings):
    """Rows sorted by (_tok, _i, _j), one pair of blocks after the other, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            links = _compare(pa.Table.from_batches(held), s) if held else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(key[lo])
                if now != last:
                    yield from flush()
                    held, last = [], now
                held.append(batch.slice(lo, hi - lo))
        yield from flush()

    return run


def link_classes(signed: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """(node, root) of classes that are linked; signed: _id, _t, _cls, _sig of rows, docs: _id, _t, _text of the same."""
    classes = signed.filter("_cls is not null").groupBy("_cls").agg(F.min(F.struct("_id", "_t")).alias("_rep"), F.min("_sig").alias("_sig"))
    classes = stage(classes.withColumn("_alias", F.xxhash64("_cls")), "classes")
    # Screen. Two classes of one alias would be screened together, which never loses any.
    pairs = classes.select("_alias", F.explode("_sig").alias("_tok"))
    # Counts are tables of their own, so that both sides of a join with them are plain exchanges and a hot list's rows can be split.
    common = lambda pairs: stage(pairs.groupBy("_tok").agg(F.count("*").alias("_n")).filter("_n > 1"), "counts")
    left = pairs.join(common(pairs), "_tok").groupBy("_alias").agg(F.count("*").alias("_m")).filter(F.col("_m") >= s.screen_match)
    wanted = classes.join(left.select("_alias"), "_alias", "left_semi").select("_cls", F.col("_rep._id").alias("_wid"), F.col("_rep._t").alias("_wt"))
    texts = docs.join(wanted, docs["_id"].eqNullSafe(wanted["_wid"]) & (docs["_t"] == wanted["_wt"])).select("_cls", "_text")
    sets = stage(texts.mapInArrow(_sets(s), "_cls binary, _sig binary, _set binary").dropDuplicates(["_cls"]), "sets")
    # Prefix.
    words = F.transform(F.sequence(F.lit(0), F.lit(s.coords - 1)), lambda i: F.xxhash64(i, F.substring("_sig", i * 8 + 1, F.lit(8))))
    pairs = stage(sets.select("_cls", F.explode(words).alias("_tok")), "pairs")
    shared = pairs.join(common(pairs), "_tok").groupBy("_cls").agg(F.sort_array(F.collect_list(F.struct("_n", "_tok"))).alias("_p")).filter(F.size("_p") >= s.min_match)  # at most `coords` pairs a class
    first = F.transform(F.slice("_p", F.lit(1), F.size("_p") - (s.min_match - 1)), lambda x: x["_tok"])
    prefix = shared.select("_cls", F.size("_p").alias("_m"), first.alias("_first"))
    posted = prefix.select("_cls", "_m", F.posexplode("_first").alias("_at", "_tok"), "_first").select("_tok", "_cls", "_m", F.slice("_first", F.lit(1), F.col("_at")).alias("_first"))
    posted = stage(posted, "postings")
    # Skip: every list against its most central class.
    centre = posted.groupBy("_tok").agg(F.count("*").alias("_n"), F.max(F.struct("_m", "_cls")).alias("_c")).filter("_n > 1")
    cand = posted.select("_tok", "_cls").join(stage(centre.select("_tok", F.col("_c._cls").alias("b")), "centres"), "_tok").filter("_cls <> b").select(F.greatest("_cls", "b").alias("a"), F.least("_cls", "b").alias("b")).distinct()
    both = cand.join(sets.toDF("a", "_p", "_x"), "a").join(sets.toDF("b", "_q", "_y"), "b").select("a", "b", "_p", "_q", "_x", "_y")
    links = stage(both.mapInArrow(_confirm(s), "a binary, b binary"), "links")
    roots = components(links)
    size = sets.select("_cls", F.length("_set").cast("long").alias("_bytes"))
    member = posted.join(size, "_cls").join(roots, F.col("_cls") == F.col("node"), "left")
    member = stage(member.select("_tok", "_cls", "_first", "_bytes", F.coalesce("root", "_cls").alias("_root")), "members")
    by_root = member.groupBy("_tok", "_root").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_sum"))
    main = F.max(F.struct("_n", "_sum", "_root")).alias("_main")
    mixed = by_root.groupBy("_tok").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.count("*").alias("_roots"), main).filter("_roots > 1")
    of = lambda n, size: F.ceil(F.greatest(n / s.block, size / s.block_bytes)).cast("long")
    mixed = mixed.select("_tok", F.col("_main._root").alias("_main"), of(F.col("_n") - F.col("_main._n"), F.col("_sum") - F.col("_main._sum")).alias("_ni"), of(F.col("_n"), F.col("_sum")).alias("_nj"))
    dealt = member.join(stage(mixed, "mixed"), "_tok").join(sets, "_cls")
    block, upto = lambda n: F.pmod(F.xxhash64("_cls"), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cols = ["_tok", "_i", "_j", "_one", "_cls", "_root", "_first", "_sig", "_set"]
    one = dealt.filter("_root <> _main").withColumn("_j", upto(F.col("_nj"))).withColumn("_i", block(F.col("_ni"))).withColumn("_one", F.lit(True))
    other = dealt.withColumn("_i", upto(F.col("_ni"))).withColumn("_j", block(F.col("_nj"))).withColumn("_one", F.lit(False))
    cells = one.select(cols).unionByName(other.select(cols)).repartition("_tok", "_i", "_j").sortWithinPartitions("_tok", "_i", "_j")
    more = cells.mapInArrow(_blocks(s), "a binary, b binary")
    return components(links.unionByName(stage(more, "links")))


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept, _t (hash of the text) and _stays (the one (id, _t) of each component that stays) for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    signed = stage(rows.mapInArrow(_sign(s), f"_id {kind}, _t long, n_shingles long, _cls binary, _sig array<long>"), "signatures")
    roots = link_classes(signed, rows, s)
    # Rows without a set stay apart: a join would bring them all to one task.
    own = signed.select("_id", "_t", "n_shingles", "_cls")
    named = own.filter("_cls is not null").join(roots, F.col("_cls") == F.col("node"), "left").select("_id", "_t", "n_shingles", F.coalesce("root", "_cls").alias("_root"))
    named = stage(named, "named")
    least = stage(named.groupBy("_root").agg(F.min("_id").alias("component_id"), F.min(F.struct("_id", "_t")).alias("_one")), "least")
    empty = own.filter("_cls is null").select("_id", "_t", "n_shingles", F.col("_id").alias("component_id"), F.struct("_id", "_t").alias("_one"))
    out = named.join(least, "_root").select(*empty.columns).unionByName(empty)
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), "_t", F.struct("_id", "_t").eqNullSafe(F.col("_one")).alias("_stays"))
