"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

A document is the weighted set of its five-word shingles, weight being how often
each occurs.  Darts are thrown into the regions [0, weight] x [0, rank): each
unit of weight of a shingle has its own stream of hashed arrivals of rate 1, so
equal regions get equal darts in all documents, and about COORDINATES * (ln
COORDINATES + 3) darts are thrown whatever the document's length.  Each dart
names a coordinate; the earliest dart of each is the signature.  Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents that share a band are first paired with one member of the bucket,
chosen by hash, other ones in other bands: at most LEADERS pairs a document and
leader, checked exactly on the whole texts.  What stays in several classes
within a bucket meets in cells of bounded size that hold the documents'
shingles: pairs of different classes that agree in AGREE coordinates are checked
exactly there, classes merge as links are found, and a cell gives back only the
links that merged two classes, fewer than it has members.  Classes are connected
components, found by contracting links with DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import U64, Words, flat, materialize, mix, ngrams, ranges, whole_row

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Different choices of a bucket's leader.
LEADERS = 3
#: Pairs with fewer agreeing coordinates are not near: four standard deviations below SIMILAR.
AGREE = 60
#: A block of a bucket in a cell: so many members, so many shingles (8 bytes each).
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
#: Tables of ids are broadcast up to so many rows (24 bytes each); beyond, both sides of their join are dealt.
FEW = 500_000
CHUNK = 2 << 20


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1) / 2.0**53


def _slots(shingles: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of weight: the j-th occurrence of a shingle in its document.

    Equal shingles of a document need only be neighbours, so one sort by a mixed key will do.
    """
    order = np.argsort(shingles ^ mix(doc.astype(U64) + U64(1)))
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    k = np.arange(len(s))
    nth = (k - np.maximum.accumulate(np.where(new, k, 0))).astype(U64)
    return mix(s + nth * U64(0x9E3779B97F4A7C15)), d


def signatures(shingles: np.ndarray, doc: np.ndarray, n: int, size: int = COORDINATES) -> np.ndarray:
    """n rows of `size` dart hashes; documents without shingles have zeros."""
    best = np.full(n * size, np.inf)
    name = np.zeros(n * size, U64)
    if not len(shingles):
        return name.reshape(n, size)
    slot, where = _slots(shingles, doc)
    weight = np.bincount(where, minlength=n).astype(np.float64)
    limit = size * (np.log(size) + 3) / np.maximum(weight, 1)
    begun = np.zeros(len(slot))
    turn = 0
    open_ = np.ones(n, bool)
    while True:
        turn += 1
        h = mix(slot ^ U64(turn * 0xD6E8FEB86659FD93 & 2**64 - 1))
        begun = begun - np.log(_unit(h))
        hit = begun <= limit[where]
        if not hit.any():
            # Some coordinate may have no dart: such documents go on to twice the rank.
            missing = np.isinf(best.reshape(n, size)).any(axis=1) & open_ & (weight > 0)
            if not missing.any():
                break
            limit[missing] *= 2
            slot_all, where_all = _slots(shingles, doc)
            keep = missing[where_all]
            slot, where = slot_all[keep], where_all[keep]
            begun, turn = np.zeros(len(slot)), 0
            again = np.repeat(missing, size)
            best[again], name[again] = np.inf, 0
            open_ = missing
            continue
        slot, where, begun, h = slot[hit], where[hit], begun[hit], h[hit]
        dart = mix(h ^ U64(0xA24BAED4963EE407))
        at = where * size + (dart % U64(size)).astype(np.int64)
        before = best[at]
        np.minimum.at(best, at, begun)
        o = np.flatnonzero((begun < before) & (begun == best[at]))
        name[at[o]] = U64(2**64 - 1)
        np.minimum.at(name, at[o], dart[o])
    return name.reshape(n, size)


_SIGNED = ["doc_id", "t", "w1", "w2", "weight", "bands", "sig"]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash of the words, weight, band hashes and signature of each document; nulls for those without words."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in ranges(offsets, CHUNK):
            words = Words(data, offsets, i, j)
            full, bare = np.flatnonzero(words.count > 0), np.flatnonzero(words.count == 0)
            if len(bare):
                named = [batch.column(c).slice(i, j - i).take(pa.array(bare)) for c in ("doc_id", "t")]
                yield pa.RecordBatch.from_arrays([*named, *(pa.nulls(len(bare), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=_SIGNED)
            if not len(full):
                continue
            shingles, doc = ngrams(words, SHINGLE)
            sig = signatures(shingles, doc, j - i)[full]
            bands = np.zeros((len(full), BANDS), U64)
            for r in range(ROWS):
                bands = mix((bands * U64(0x9FB21C651E98DF25)) ^ sig[:, r::ROWS] ^ U64(r))
            k = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.count)
            same = [np.add.reduceat(mix(words.hash ^ mix(k.astype(U64) + U64(salt))), words.first[:-1][full]).view(np.int64) for salt in (1, 1 << 40)]
            low = (sig & U64(0xFFFF)).astype(np.uint16)
            ids, texts = (batch.column(c).slice(i, j - i).take(pa.array(full)) for c in ("doc_id", "t"))
            yield pa.RecordBatch.from_arrays(
                [ids, texts, pa.array(same[0]), pa.array(same[1]), pa.array(np.bincount(doc, minlength=j - i)[full], pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([row.tobytes() for row in low], pa.binary())],
                names=_SIGNED,
            )


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted Jaccard similarity of two texts' shingles."""
    for batch in batches:
        n = batch.num_rows
        out = np.zeros(n)
        sides = [flat(batch.column(c)) for c in ("ta", "tb")]
        both = np.diff(sides[0][1]) + np.diff(sides[1][1])
        for i, j in ranges(np.append(0, np.cumsum(both)), CHUNK):
            slots = [_slots(*ngrams(Words(*side, i, j), SHINGLE)) for side in sides]
            sizes = [np.bincount(d, minlength=j - i) for _, d in slots]
            h, d = (np.concatenate(x) for x in zip(*slots))
            order = np.argsort(h ^ mix(d.astype(U64) + U64(1)))
            h, d = h[order], d[order]
            shared = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=j - i)
            out[i:j] = shared / np.maximum(sizes[0] + sizes[1] - shared, 1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "similarity"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the sorted hashes of its units of weight."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in ranges(offsets, CHUNK):
            slot, doc = _slots(*ngrams(Words(data, offsets, i, j), SHINGLE))
            slot = slot[np.lexsort((slot, doc))]
            cut = np.append(0, np.cumsum(np.bincount(doc, minlength=j - i)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([slot[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "slots"])


class Cell:
    """Members of a bucket, by their class, shingles and signature; finds the links between their classes.

    A cell holds one block of a bucket, or two whose members are compared across only.
    """

    def __init__(self, classes: np.ndarray, blocks: np.ndarray, band: int, sigs: list[bytes], slots: list[bytes]) -> None:
        self.classes, self.blocks, self.band = classes.copy(), blocks, band
        self.sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(classes), BANDS, ROWS)
        self.size = np.array([len(x) // 8 for x in slots])
        self.start = np.append(0, np.cumsum(self.size))
        self.slots = np.frombuffer(b"".join(slots), U64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact weighted Jaccard similarity of member i to each of others."""
        mine, sizes = self.slots[self.start[i] : self.start[i + 1]], self.size[others]
        begin = np.append(0, np.cumsum(sizes))[:-1]
        theirs = self.slots[np.arange(sizes.sum()) + np.repeat(self.start[others] - begin, sizes)]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), begin)
        return shared / (len(mine) + sizes - shared)

    def candidates(self, i: int, pool: np.ndarray) -> np.ndarray:
        """Members of pool in other classes that agree enough with i, most first; pairs meet in the first band they share."""
        pool = pool[self.classes[pool] != self.classes[i]]
        small, large = np.minimum(self.size[pool], self.size[i]), np.maximum(self.size[pool], self.size[i])
        pool = pool[small >= SIMILAR * large]
        if not len(pool):
            return pool
        equal = self.sig[pool] == self.sig[i]
        agree = equal.sum(axis=(1, 2))
        keep = np.flatnonzero((agree >= AGREE) & (equal.all(axis=2).argmax(axis=1) == self.band))
        return pool[keep[np.argsort(-agree[keep], kind="stable")]]

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of classes that a link merges; afterwards all members joined by links within the cell are of one class."""
        k = np.arange(len(self.classes))
        one = self.blocks.min() == self.blocks.max()
        here = k if one else np.flatnonzero(self.blocks == self.blocks.min())
        across = k if one else np.flatnonzero(self.blocks != self.blocks.min())
        for i in here:
            pool, turn = self.candidates(i, across[across > i] if one else across), 8
            while len(pool):
                some, pool = pool[:turn], pool[turn:]
                for j in some[self.similar(i, some) >= SIMILAR]:
                    x, y = self.classes[i], self.classes[j]
                    if x != y:
                        yield min(x, y), max(x, y)
                        self.classes[self.classes == max(x, y)] = min(x, y)
                pool, turn = pool[self.classes[pool] != self.classes[i]], turn * 4


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes from rows sorted by cell."""
    names = ("class_id", "block", "band", "sig", "slots")

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        classes, blocks, bands, sigs, slots = zip(*rows)
        if len(set(classes)) > 1:
            found = list(Cell(np.array(classes, np.int64), np.array(blocks), bands[0], sigs, slots).links())
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(x).to_pylist() for x in ("cell", *names))):
            if k != key:
                if rows:
                    yield from done(rows)
                key, rows = k, []
            rows.append(tuple(row))
    if rows:
        yield from done(rows)


def _open(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """cell, doc_id, class_id, block, band: members of buckets that hold several classes.

    Of buckets with the same members that of the first band stays.  The members
    of a bucket's largest class need no comparison with each other: they get
    blocks of their own, numbered below 0, and each is copied only to the blocks
    of the rest.  Blocks are of bounded size, and each two meet in a cell.
    """
    named = buckets.join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    counted = named.groupBy("bucket", "band", "class_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    several = counted.groupBy("bucket", "band").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class_id", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x").alias("x"), F.sum("y").alias("y")).filter("classes > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    split = several.groupBy("n", "x", "y").agg(F.min_by(F.struct("bucket", "band", "top", "w"), "band").alias("s")).select(
        "s.bucket", "s.band", F.col("s.top.class_id").alias("top"), blocks(F.col("s.top.n"), F.col("s.top.w")).alias("top_blocks"), F.greatest(blocks(F.col("n") - F.col("s.top.n"), F.col("s.w") - F.col("s.top.w")), F.lit(1)).alias("blocks"),
    )
    is_top = F.col("class_id") == F.col("top")
    number = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    dealt = named.join(split, ["bucket", "band"]).withColumn("block", F.when(is_top, -1 - number(F.col("top_blocks"))).otherwise(number(F.col("blocks"))))
    met = dealt.withColumn("o", F.explode(F.sequence(F.when(is_top, 0).otherwise(-F.col("top_blocks")), F.col("blocks") - 1)))
    return met.select(F.xxhash64("bucket", F.least("block", "o"), F.greatest("block", "o")).alias("cell"), "doc_id", "class_id", "block", "band")


def components(links: DataFrame) -> DataFrame:
    """doc_id, class_id: the least id reachable over links (a, b), for each id in a link.

    Each round hooks every id to its least neighbour and that one's, and puts
    these in the links' place; links within a class vanish, so each round has
    fewer.  The rounds' maps are chained at the end, the small ones first.
    """
    maps = []
    while True:
        edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if maps and edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "hooks")
        over = materialize(hooks.join(hooks.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p")), "over")
        maps.append(over)
        links = edges.join(over, "a").select(F.col("p").alias("a"), "b").join(over.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
    found = maps.pop()
    while maps:
        onward = found.select(F.col("a").alias("p"), F.col("p").alias("last"))
        found = maps.pop().join(onward, "p", "left").select("a", F.coalesce("last", "p").alias("p"))
    return materialize(found.select(F.col("a").alias("doc_id"), F.col("p").alias("class_id")), "classes")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough; a leader with many pairs is a skewed key, which the adaptive join splits."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(_jaccard, "a long, b long, similarity double").filter(F.col("similarity") >= SIMILAR)


def _sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most FEW rows; else the join deals both sides."""
    return F.broadcast(df) if df.count() <= FEW else df


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the wanted (doc_id, t), once each."""
    return rows.join(_sent(wanted), ["doc_id", "t"], "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies, t (hash of the text that counts), for each doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, t long, w1 long, w2 long, weight long, bands array<long>, sig binary"), "signatures")
    ids = signed.groupBy("doc_id").agg(F.max("t").alias("t"), F.min("t").alias("low"))
    torn = materialize(ids.filter("low <> t").select("doc_id", F.col("t").alias("chosen")), "torn")
    if not torn.isEmpty():
        # Ids that come with several texts: only the chosen one's rows stay.
        signed = signed.join(_sent(torn), "doc_id", "left").filter("chosen IS NULL OR t = chosen").drop("chosen")
    worded = signed.filter("w1 IS NOT NULL")
    leads = materialize(worded.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "t", "weight", "bands", "sig")).alias("lead")).select("w1", "w2", "lead.*"), "leads")
    banded = leads.select("doc_id", "weight", F.posexplode("bands").alias("band", "h")).select("doc_id", "weight", "band", F.xxhash64("band", "h").alias("bucket"))
    chosen = F.min(F.struct(F.xxhash64("doc_id", F.pmod("band", F.lit(LEADERS))), "doc_id"))["doc_id"]
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n"), chosen.alias("a")).filter("n > 1")
    buckets = materialize(banded.join(crowded.select("bucket", "a"), "bucket").select("bucket", "band", "doc_id", "weight", "a"), "buckets")
    known = leads.select("doc_id", "t")
    texts = _texts(rows, known.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))
    tried = buckets.filter("doc_id <> a").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    first = components(_verified(tried, texts).select("a", "b"))
    open_ = materialize(_open(buckets.drop("a"), first), "open")
    slots = _texts(rows, known.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")).mapInArrow(_shingled, "doc_id long, slots binary")
    met = open_.join(leads.select("doc_id", "sig"), "doc_id").join(slots, "doc_id").repartition("cell").sortWithinPartitions("cell")
    then = components(met.mapInArrow(_cells, "a long, b long"))
    # What belongs to a representative is joined to it first, so that its copies, which may be many, meet it only once.
    members = worded.select("doc_id", "w1", "w2").distinct()
    named = leads.select("w1", "w2", "doc_id").join(first, "doc_id", "left").withColumn("c", F.coalesce("class_id", "doc_id"))
    named = named.join(then.select(F.col("doc_id").alias("c"), F.col("class_id").alias("last")), "c", "left").select("w1", "w2", F.coalesce("last", "c").alias("class_id"))
    copies = members.groupBy("w1", "w2").agg(F.count("*").alias("n_copies"))
    found = members.join(named.join(copies, ["w1", "w2"]), ["w1", "w2"]).select("doc_id", "class_id", "n_copies")
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "t")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies, one row a doc_id.

    Documents are near if the weighted Jaccard similarity of their five-word
    shingles is 0.8 or more; a class is what such links connect, named by its
    least doc_id.  n_copies: documents with the same words in the same order.
    Words are runs of bytes other than ASCII white space, A-Z as a-z; a text of 1
    to 4 words is one shingle.  Texts without words (null, empty, white space)
    are near to none.  Of rows that repeat a doc_id one text counts, that with
    the greatest hash; rows without doc_id are left out.  Only doc_id and text
    are read, whatever other columns there are.
    """
    return _classes(docs).select("doc_id", "class_id", "n_copies")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; all columns are kept.

    Of rows that repeat a doc_id and its text one stays.  Rows without doc_id
    stay, and so do rows of a repeated doc_id whose text is not the one that
    counts (see near_duplicates), as nothing was compared with them.
    """
    key, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    fate = materialize(_classes(docs).select(F.col("doc_id").alias("_key"), F.col("class_id").alias("_class"), F.col("t").alias("_t")), "fate")
    whole = docs.filter(key.isNotNull()).select(key.alias("_key"), text.alias("_text"), whole_row(docs).alias("_row"))
    # Whole rows move once: the join has dealt them by the id already.
    kept = whole.join(fate, "_key").filter("_text <> _t OR _key = _class").dropDuplicates(["_key", "_text"]).select("_row.*")
    return kept.unionByName(docs.filter(key.isNull()))
