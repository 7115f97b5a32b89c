"""Operator 12, the Jaccard join of word shingles by token-combination prefixes.

Tokens are the distinct ``SHINGLE``-word shingles of a text, in one order: rare ones first, then the classes of
frequent ones, by hash within a class. Two sets at the least similarity differ by at most t = n - 0.8 n of each
one's n tokens, so they share one of the first t + 1 of either. Where those are rare, they are the set's signatures,
one by one. A token of class k is frequent, and only combinations of k of them are signatures: the tokens of a class
are dealt over parts by hash, and all k-combinations of a part's tokens in the prefix are taken. A pair shares none of them only if
all but k - 1 of the part's tokens are missing in the other, so a part with c tokens in the prefix stands for c - k + 1 differences, and
the prefix is extended until all parts and the single tokens stand for t + 1. The number of parts follows
from the band of sizes; a set close below the next band takes part in that, too. With k up to 3, only sets of three and fewer tokens
can fall short, and these link with equal sets alone, which are one node from the start.

Classes come from counts: of all sets' first tokens by hash, some more than t + 1, and of all tokens of the sets that have too few rare
ones there, until there is no further one. Sets that share a signature are candidates. A set with combinations has all its rare
tokens among its signatures, so two sets that meet at a combination either meet at a rare token as well or have at most their
frequent tokens in common; where these are too few, as with a passage that very many texts hold, the combination makes no pair of
them. Bitmaps of tokens rule most other false ones out without a loss, and each link is verified on the sets. Of a signature's sets not all pairs are
taken: in a round its most shared sets, ``LEADS`` times more from round to round, are compared with all the others that they are not
connected with yet, then leave it, until all its sets are connected or none is left. So a group of near copies
takes about one comparison for each text, and every pair is linked, connected otherwise, or verified not to be one.

Results for odd rows: null, empty and blank texts have the empty set, no link, and their own doc_id as component_id; a
text of one to four words has one shingle of all of them. A null doc_id never becomes a component_id unless the component has no
other. Rows that share a doc_id are linked row by row. A text takes some hundred bytes of memory for each of its words. An
empty table gives no rows. Other columns are not read. Shingles, sets and rows are 64-bit hashes; of n distinct ones two share a
hash with odds n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm import near_copies as N
from foliant.llm._bytes import mixed
from foliant.llm._segments import packed, unpacked
from foliant.llm._tables import documents, stored
from foliant.llm.simhash import components

#: Similarity in hundredths.
LEAST = 80
#: Up to so many sets hold a token of class 1 and of class 2; the rest is class 3.
CLASSES = 64, 1 << 17
#: Tokens of the smallest set of a band for each part.
PART = 8
#: Signatures of a set by which near copies are connected first.
FIRST = 4
#: Of frequent tokens (9 bytes each) and rows of texts (16 to 33 bytes) so many are broadcast; more are joined.
BROADCAST = 1 << 20
#: Tokens beyond a prefix of single ones that are kept, for each so many tokens of a set, and so many at least.
SLACK = 16
#: By so many times more sets of a signature are compared with the others in each round.
LEADS = 4
#: Words of 64 bits of the small bitmap that goes along with a set's signatures.
WORDS = [f"w{k}" for k in range(4)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int) -> int:
    """Differences of a set of n tokens that rule a link out."""
    return n + (-LEAST * n // 100) + 1 if n else 0


def bands(n: int) -> list[int]:
    """The smallest sizes of the bands in which a set of n (4 or more) tokens takes part."""
    own = 1 << (n.bit_length() - 1)
    return [own, 2 * own] if 100 * n >= LEAST * 2 * own else [own]


def _combinations(tokens: np.ndarray, part: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of all k-combinations of tokens of one part."""
    order = np.argsort(part, kind="stable")
    t, p = tokens[order], part[order]
    most = int(np.bincount(p).max(initial=0))
    out = []
    for d in range(1, most):
        if k == 2:
            same = np.flatnonzero(p[:-d] == p[d:])
            out.append(mixed(t[same] * _STEP + mixed(t[same + d])))
        else:
            for e in range(d + 1, most):
                same = np.flatnonzero(p[:-e] == p[e:])
                out.append(mixed((t[same] * _STEP + mixed(t[same + d])) * _STEP + mixed(t[same + e])))
    return mixed(np.concatenate(out) + np.uint64(salt * 4 + k)) if out else np.zeros(0, np.uint64)


def _prefix(tokens: np.ndarray, part: np.ndarray, k: int, missing: int) -> tuple[int, int]:
    """How many of the tokens the prefix takes, and for how many differences they stand."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    rank = np.empty(len(p), np.int64)
    rank[order] = np.arange(len(p)) - np.searchsorted(p, p)
    stands = np.cumsum(rank >= k - 1)
    size = min(len(tokens), int(np.searchsorted(stands, missing)) + 1)
    return size, int(stands[size - 1]) if size else 0


def signatures(own: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The single tokens and the combinations of a set of n tokens: its first ones, ascending, and the class of each."""
    want, combined = needed(n), []
    single = own[kinds == 1][:want]
    if len(own) and len(single) < want:
        for least in bands(n):
            missing, parts = want - len(single), max(1, least // PART)
            for k in (2, 3):
                tokens = own[kinds == k]
                part = (mixed(tokens ^ np.uint64(least)) % np.uint64(parts)).astype(np.int64)
                size, stands = _prefix(tokens, part, k, missing)
                combined.append(_combinations(tokens[:size], part[:size], k, least))
                missing -= stands
                if missing <= 0:
                    break
            if missing > 0:
                raise AssertionError("a prefix stands for too few differences")
    return single, np.unique(np.concatenate(combined)) if combined else np.zeros(0, np.uint64)


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each residue that a token has, of four or more times as many as there are tokens."""
    size = max(64, 1 << (4 * len(own) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def small_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS for each set: a bit for each residue that a token has."""
    bits = np.zeros((len(sets), 64 * len(WORDS)), bool)
    for row, own in zip(bits, sets, strict=True):
        row[(own % np.uint64(64 * len(WORDS))).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def may_be_similar(other: str) -> Column:
    """By size and small bitmap, as a column: the set (n, w0, ...) and another one (other_n, other_w0, ...)."""
    alone = lambda a, b: reduce(Column.__add__, [F.bit_count(F.col(a(w)).bitwiseAND(F.bitwise_not(F.col(b(w))))) for w in WORDS])
    own, its = (lambda w: w), (lambda w: f"{other}_{w}")
    both = F.least(F.col("n") - alone(own, its), F.col(f"{other}_n") - alone(its, own))
    return (100 + LEAST) * both >= LEAST * (F.col("n") + F.col(f"{other}_n"))


def may_meet(other: str) -> Column:
    """Whether the frequent tokens alone may make the set (n, rare) and another one of the same combination similar; true of single
    tokens, where ``rare`` is null. Sets with a rare token in common meet there."""
    both = F.least(*[F.col(f"{k}n") - F.coalesce(F.col(f"{k}rare"), F.lit(0)) for k in ("", f"{other}_")])
    return (100 + LEAST) * both >= LEAST * (F.col("n") + F.col(f"{other}_n"))


def may_link(x: bytes, n_x: int, y: bytes, n_y: int) -> bool:
    """Whether sets of these bitmaps and sizes can be similar: a bit of one alone is a token of that one alone."""
    x, y = np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool), np.unpackbits(np.frombuffer(y, np.uint8)).astype(bool)
    size = min(len(x), len(y))
    x, y = x.reshape(-1, size).any(axis=0), y.reshape(-1, size).any(axis=0)
    both = min(n_x - int((x & ~y).sum()), n_y - int((y & ~x).sum()))
    return (100 + LEAST) * both >= LEAST * (n_x + n_y)


def _signed_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = 0
        for h, out in N.shingles(batch.column(2)):
            n = len(out) - 1
            sets = [np.unique(h[a:b]) for a, b in zip(out[:-1], out[1:], strict=True)]
            keys = np.fromiter((N._key(x) for x in sets), np.uint64, n)
            first = [packed(x[: needed(len(x)) + max(SLACK, len(x) // SLACK)] if len(x) > 3 else x[:0]) for x in sets]
            columns = [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(keys.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(first, pa.binary()), pa.array([bitmap(x) for x in sets], pa.binary()), *map(pa.array, small_bitmaps(sets).T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "key", "n", "own", "bits", *WORDS])
            row += n


def signed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, key, n, own, bits, w0, ...) of each row: the row's number, its set's number and size, its first tokens by hash,
    some more than a prefix of single tokens takes, its bitmap and its small one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), N._row(docs).alias("at"), "text").mapInArrow(_signed_task, "doc_id long, at long, key long, n long, own binary, bits binary, " + ", ".join(f"{w} long" for w in WORDS))


def texts_at(docs: DataFrame, rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """The texts of the rows with the given numbers ``at``."""
    wanted = rows.select("at").distinct()
    return docs.select(N._row(docs).alias("at"), "text").join(F.broadcast(wanted) if wanted.count() <= most else wanted, "at")


def sets_of(docs: DataFrame, signed: DataFrame, keys: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(key, n, own) of the given sets with all their tokens; a row that is there several times gives as many."""
    lead = stored(signed.join(keys, "key").groupBy("key").agg(F.min("at").alias("at")), "leads")
    return texts_at(docs, lead, most).join(F.broadcast(lead) if lead.count() <= most else lead, "at").select("key", "text").mapInArrow(N._set_task, "key long, n long, own binary")


def tokens_of(sets: DataFrame) -> DataFrame:
    return sets.select("key", "own").mapInArrow(N._shingle_task, "shingle long, key long")


def frequent(sets: DataFrame) -> DataFrame:
    """(shingle, kind) of the tokens in ``own`` that are not rare."""
    times = tokens_of(sets).groupBy("shingle").agg(F.count("*").alias("times")).filter(F.col("times") > CLASSES[0])
    return times.select("shingle", F.when(F.col("times") > CLASSES[1], 3).otherwise(2).alias("kind"))


def _kinds(own: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    out = np.ones(len(own), np.uint8)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        same = tokens[at] == own
        out[same] = kinds[at[same]]
    return out


def _classes(batch: pa.RecordBatch, shared) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Number, size, tokens and their classes of each set of a batch (key, n, own and, if nothing is shared, its frequent tokens)."""
    for k, (key, n, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
        own = unpacked(raw.as_buffer())
        if shared is not None:
            yield key, n, own, _kinds(own, *shared.value)
        else:
            pairs = batch.column(3)[k].as_py() or []
            tokens, kinds = np.array([x["shingle"] for x in pairs], np.int64).view(np.uint64), np.array([x["kind"] for x in pairs], np.uint8)
            order = np.argsort(tokens)
            yield key, n, own, _kinds(own, tokens[order], kinds[order])


def _is_short(n: int, kinds: np.ndarray) -> bool:
    """Whether the tokens at hand hold too few rare ones for a prefix, and are not all."""
    return n > 3 and len(kinds) < n and int((kinds == 1).sum()) < needed(n)


def _short_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [key for key, n, _, kinds in _classes(batch, shared) if _is_short(n, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64())], names=["key"])

    return run


def _signature_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, own, kinds in _classes(batch, shared):
                if not _is_short(n, kinds):
                    single, combined = signatures(own, kinds, n)
                    sigs = np.concatenate([single, combined]).view(np.int64)
                    rare = pa.array(np.full(len(sigs), len(single), np.int32), mask=np.arange(len(sigs)) < len(single))
                    yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.full(len(sigs), key, np.int64)), rare], names=["sig", "key", "rare"])

    return run


def classified(sets: DataFrame, common: DataFrame, most: int, task, schema: str) -> DataFrame:
    """What ``task`` makes of the sets (key, n, own) with the classes of their tokens."""
    sets = sets.select("key", "n", "own")
    if common.count() <= most:
        rows = common.toArrow()
        tokens = np.asarray(rows.column("shingle")).view(np.uint64)
        order = np.argsort(tokens)
        return sets.mapInArrow(task(sets.sparkSession.sparkContext.broadcast((tokens[order], np.asarray(rows.column("kind")).astype(np.uint8)[order]))), schema)
    own = tokens_of(sets).join(common, "shingle").groupBy("key").agg(F.collect_set(F.struct("shingle", "kind")).alias("common"))
    return sets.join(own, "key", "left").select("key", "n", "own", "common").mapInArrow(task(None), schema)


def signature_rows(docs: DataFrame, signed: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(sig, key, rare) of the signatures that several sets have; ``rare`` is null for a single token, and how many rare tokens the
    set has (all are signatures then) for a combination."""
    common = stored(frequent(signed), "frequent")
    whole = []
    while True:
        keys = classified(signed, common, most, _short_task, "key long").distinct()
        keys = stored(reduce(lambda df, done: df.join(done.select("key"), "key", "left_anti"), whole, keys), "short")
        if keys.isEmpty():
            break
        whole.append(stored(sets_of(docs, signed, keys, most), "sets"))
        common = stored(common.unionAll(frequent(whole[-1])).groupBy("shingle").agg(F.max("kind").alias("kind")), "frequent")
    rows = stored(reduce(DataFrame.unionAll, [classified(sets, common, most, _signature_task, "sig long, key long, rare int") for sets in (signed, *whole)]), "signatures")
    # single tokens have few holders, so that one window tells which are shared; combinations may have very many
    own = Window.partitionBy("sig")
    few = rows.filter("rare IS NULL").withColumns({"low": F.min("key").over(own), "high": F.max("key").over(own)}).filter("low < high").select("sig", "key", "rare")
    many = rows.filter("rare IS NOT NULL")
    several = many.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("sig")
    return few.unionAll(many.join(several, "sig")).distinct()


def _bitmap_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n_a, n_b, x, y = (batch.column(k).to_pylist() for k in range(6))
        able = [may_link(*args) for args in zip(x, n_a, y, n_b, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(able, pa.bool_()))


def _at_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in N._set_task(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["at", "own"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, most: int = BROADCAST) -> DataFrame:
    """Those of the pairs (a, b) of ``nodes`` (key, at, n, bits) that are similar enough; bitmaps first, then the sets, of which one
    from either end meets the other once."""
    x, y = (nodes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"), F.col("at").alias(f"at_{k}")) for k in "ab")
    able = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bitmap_task, "a long, b long")
    able = stored(able, "able")
    at = nodes.select("key", "at")
    ends = able.select(F.explode(F.array(F.struct("a", "b", F.col("a").alias("key")), F.struct("a", "b", F.col("b").alias("key")))).alias("e")).select("e.*").join(at, "key")
    ends = stored(ends.select("at", "a", "b", (F.col("key") == F.col("a")).alias("first")), "ends")
    sets = texts_at(docs, ends, most).select("at", "text").mapInArrow(_at_task, "at long, own binary")
    sent = sets.join(F.broadcast(ends) if ends.count() <= most else ends, "at")
    met = sent.groupBy("a", "b").agg(F.first(F.when(F.col("first"), F.col("own")), True).alias("own_a"), F.first(F.when(~F.col("first"), F.col("own")), True).alias("own_b"))
    return met.mapInArrow(N._similar_task, "a long, b long")


def telling(rows: DataFrame) -> DataFrame:
    """Of (sig, key, rare, root) the signatures whose sets are not all connected; of several with the same sets one alone, such as of
    those that a passage brings: a single token before a combination, which makes fewer pairs."""
    alike = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.max(F.col("rare").isNotNull()).alias("combined"))
    return alike.filter("low < high").groupBy("n", "x", "y").agg(F.min(F.struct("combined", "sig")).alias("s")).select("s.sig")


def links(docs: DataFrame, signed: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(node, root) over the sets that have links: the smallest set that each is connected with."""
    rows = stored(signature_rows(docs, signed, most), "shared")
    coded = rows.join(telling(rows.withColumn("root", F.col("key"))), "sig").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("sig", "rare"))).alias("sigs"))
    nodes = signed.groupBy("key").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("bits").alias("bits"), *[F.first(w).alias(w) for w in WORDS])
    coded = stored(coded.join(nodes, "key").withColumn("rank", F.size("sigs") / F.col("n")), "coded")
    nodes, coded = coded.select("key", "at", "n", "bits"), coded.select("key", "n", "rank", *WORDS, "sigs")
    tried, roots = [], None
    own = ["key", "n", "rank", *WORDS]
    held = coded.select(*own, F.col("key").alias("root"), F.explode(F.slice("sigs", 1, FIRST)).alias("s")).select(*own, "root", "s.*")
    for step in count():
        # the first step takes few signatures; what they connect needs no comparison later on
        leads = held.withColumn("place", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("rank"), "key")))
        leads = leads.filter(F.col("place") <= LEADS ** max(0, step - 1)).select("sig", F.col("key").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in ("n", "rare", "root", *WORDS)])
        pairs = held.join(leads, "sig").filter((F.col("root") != F.col("lead_root")) & may_meet("lead") & may_be_similar("lead")).select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
        pairs = stored(reduce(lambda df, done: df.join(done, ["a", "b"], "left_anti"), tried, pairs), "pairs")
        tried.append(pairs)
        found = pairs if pairs.isEmpty() else stored(verified(docs, nodes, pairs, most), "links")
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))
        at = roots.select(F.col("node").alias("key"), F.col("root").alias("known"))
        if step == 0:
            rooted = coded.join(at, "key", "left").select(*own, F.coalesce("known", "key").alias("root"), F.explode("sigs").alias("s")).select(*own, "root", "s.*")
        else:
            left = held.join(leads.select("sig", F.col("lead").alias("key")), ["sig", "key"], "left_anti")
            rooted = left.join(at, "key", "left").withColumn("root", F.coalesce("known", "root")).select(*own, "root", "sig", "rare")
        held = stored(rooted.join(telling(rooted), "sig"), "held")
        if held.isEmpty():
            return roots


def linked(docs: DataFrame, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    signed = stored(signed_rows(docs), "signed")
    roots = links(docs, signed, most).select(F.col("node").alias("key"), "root")
    narrow = signed.select("doc_id", "key", "n")
    groups = narrow.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    known = narrow.join(groups.join(least, "root").select("key", "component_id"), "key", "left")
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


QUERIES = {"op12_jaccard_join": op12_jaccard_join}
#: Components are an iteration without a SQL form that ends on these tables; tests/llm/test_jaccard_join.py has the brute force.
ORACLES: dict[str, str] = {}
