"""N-gram Jaccard join by parity sketches (operator 1).

A document is the set of its distinct n-word shingles (A-Z lower-cased); two link when their Jaccard similarity is at least
num / den. Then their symmetric difference is at most (a + b) * (den - num) / (den + num) for set sizes a and b. XOR-hashing the
shingles into bit sketches keeps parities, so the Hamming distance of two sketches is at most that difference.

Size bands hold sizes up to GROWTH times their least. In a band, sketches have some more blocks than the largest difference k that
a linked pair may have there, so such a pair agrees in at least blocks - k of them (pigeonhole); a set also takes part in the next band
if it could link there. A block's join key is a digest of what was XOR-ed into it. Blocks without a rare shingle are weak: empty ones,
and those made of passages that very many documents share (a bounded list, estimated on every SAMPLE-th document; any list gives the
same links). Equal blocks are equally weak, so a set with fewer than blocks - k weak ones needs only its strong blocks as keys; any
other takes part in a further, independent sketch. In the last one such sets, mostly made of shared passages, take their rare shingles as
keys (those with the smallest hashes, as many as a linked set may lack and one more), and their weak blocks if they have few rare ones: a linked pair shares a rare shingle, or their excesses (rare shingles less what
the bound allows a set of that size) add up to 0 at most. So texts of one passage with different additions are compared only where the
additions are small enough to link. No link is lost, whatever the sizes.

Equal sets are one class (an aggregate), of which only a representative joins. Keys are hashed to partitions; hot ones (by the sample,
a bounded list) are dealt over partitions by id, and their parts are joined by later rounds. One pass over the sorted rows gives groups
with leaders. Each member of a group is tried against the leaders that it shares most keys with, by a folded sketch's Hamming distance and
then by its exact set. What is linked is contracted to components; a group within one component is done. Then rows outside a group's largest component are
tried against some members of that, once and as long as the pairs left are very many for the rows; at last they
are compared with the whole group, in cells, by sketch and excess within the join, and by set if that passes.
So pairs within a group of linked copies are never made, and no link between components is missed. What the join gives is components;
links within one component aren't all made.

Shingles are told apart by 64-bit hashes. Defined cases: null, empty and wordless texts have an empty set and link with nothing; a
text with fewer words than n has its whole sequence as the one shingle. Ids are whole numbers (others are refused). Rows that share an id are
one node: they're in one component. A null id is in no component (null). An empty table gives no rows. Extra columns are ignored by
`jaccard_components`, kept by `drop_near_copies`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import HOT_ROWS, arrow_map, by_ids, hot_join, materialize, most_frequent, release, whole_number_ids
from weftline.llm.components import components
from weftline.llm.spans import U64, Words, mix, shingle_sets, slices

GROWTH, FAMILIES, FOLD = 1.4, 3, 16
#: Shingles in COMMON_DOCS or more of every SAMPLE-th document are common; at most COMMON of them are listed.
SAMPLE, COMMON_DOCS, COMMON = 32, 4, 1 << 17
#: Leaders that a row is tried against in a round, and those of a group in later rounds.
TRIES, LEADERS = 2, 4
#: Rounds of leaders go on while more pairs than this, for each grouped row, are left to compare.
PAIRS_PER_ROW, ROUNDS = 256, 8
#: Groups of more rows are compared in cells of about CELL by CELL.
CELL = 1000


@lru_cache(maxsize=8)
def bands(top: int) -> np.ndarray:
    """Least sizes of the bands, up to one above `top`."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * GROWTH))))
    return np.array([*out, max(out[-1] + 1, int(np.ceil(out[-1] * GROWTH)))])


def sets_of(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) pairs in document order, and each document's set size."""
    doc, h = shingle_sets(Words(raw, offs, lower=True), n)
    return doc, h, np.bincount(doc, minlength=len(offs) - 1)


def _digest_rows(raw: np.ndarray, offs: np.ndarray, n: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Set size, two order-free digests, the folded parity sketch (FOLD words), and the number of rare shingles of each document."""
    doc, h, size = sets_of(raw, offs, n)
    n_docs = len(size)
    m1, m2 = mix(h ^ U64(0x1B873593CC9E2D51)), mix(h ^ U64(0x52DCE729DA3E39CB))
    at = np.concatenate(([0], np.cumsum(size)))
    with np.errstate(over="ignore"):
        run1, run2 = np.concatenate(([U64(0)], np.cumsum(m1))), np.concatenate(([U64(0)], np.cumsum(m2)))
        d1, d2 = run1[at[1:]] - run1[at[:-1]], run2[at[1:]] - run2[at[:-1]]
    fold = np.zeros(n_docs * FOLD, U64)
    np.bitwise_xor.at(fold, doc * FOLD + ((m1 >> U64(6)) % U64(FOLD)).astype(np.int64), U64(1) << (m1 & U64(63)))
    return size, d1, d2, fold.reshape(n_docs, FOLD), np.bincount(doc[rare_of(h, common)], minlength=n_docs)


def band_blocks(edges: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each band's sketch, and how many of them a linked pair agrees in at least."""
    k = 2 * (edges[1:] - 1) * (den - num) // (den + num)
    least = np.ceil(edges[:-1] * num / den)  # of the sets that take part
    spare = 1 + np.where(k >= 4, np.ceil(2 * (k + 1) * np.exp(-least / (k + 1))), 0).astype(np.int64)
    return k + spare, spare


def rare_of(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles aren't in the sorted list of common ones."""
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h if len(common) else np.ones(len(h), bool)


def block_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every sketch block and rare shingle that joins; keys of weak blocks are odd, all others even. common: sorted hashes of shingles that make no block strong."""
    edges = bands(int(size.max()) if len(size) else 1)
    all_blocks, all_spare = band_blocks(edges, num, den)
    own = np.searchsorted(edges, size, "right") - 1
    some = np.flatnonzero(size > 0)
    upper = some[size[some] * den >= num * edges[own[some] + 1]]
    member, band = np.concatenate((some, upper)), np.concatenate((own[some], own[upper] + 1))
    first = np.concatenate(([0], np.cumsum(size)))
    rare = rare_of(h, common)
    n_rare = np.bincount(doc[rare], minlength=len(size))
    docs, keys = [], []
    for family in range(FAMILIES):
        if not len(member):
            break
        blocks = all_blocks[band]
        base = np.concatenate(([0], np.cumsum(blocks)))
        n = size[member]
        place = np.repeat(np.arange(len(member)), n)
        source = np.arange(int(n.sum())) + np.repeat(first[member] - (np.cumsum(n) - n), n)
        x = mix(h[source] ^ mix(np.full(1, family * 1000 + 7, U64)) ^ mix(band[place].astype(U64) + U64(1)))
        cell = base[place] + (x % blocks[place].astype(U64)).astype(np.int64)
        sketch, strong = np.zeros(base[-1], U64), np.zeros(base[-1], bool)
        np.bitwise_xor.at(sketch, cell, mix(x))
        strong[cell[rare[source]]] = True
        of = np.repeat(np.arange(len(member)), blocks)
        weak = blocks - np.bincount(of[strong], minlength=len(member))
        again = weak >= all_spare[band]
        use = strong
        if family == FAMILIES - 1:
            # excess() of a document in this band is at least r * (den + num) - (largest size) * (den - num)
            pure = n_rare[member] * (den + num) <= 2 * (edges[band + 1] - 1) * (den - num)
            use = strong | (again & pure)[of]
            # two sets that link lack at most k of each other's rare shingles, so those that share one share one of the k + 1 with the smallest hashes of either (prefix filter)
            rows = np.flatnonzero(again[place] & rare[source])
            rows = rows[np.lexsort((h[source[rows]], place[rows]))]
            of_member = place[rows]
            nth = np.arange(len(rows)) - np.searchsorted(of_member, of_member)
            k = 2 * (edges[1:] - 1) * (den - num) // (den + num)
            some = np.unique(source[rows[nth <= k[band[of_member]]]])
            docs.append(doc[some])
            keys.append(mix(h[some] ^ U64(0x7F4A7C15F39CC060)) & ~U64(1))
        at = of[use]
        with np.errstate(over="ignore"):
            label = ((band[at] * 8 + family).astype(U64) << U64(40)) + (np.flatnonzero(use) - base[at]).astype(U64)
            keys.append((mix(sketch[use] ^ mix(label)) & ~U64(1)) | (~strong[use]).astype(U64))
        docs.append(member[at])
        member, band = member[again], band[again]
    return (np.concatenate(docs), np.concatenate(keys)) if docs else (np.empty(0, np.int64), np.empty(0, U64))


def _groups(shared_hot):
    """From rows (key, id, salt) in order: (key, id, leader) of groups of two or more; of hot keys, which lie in several partitions with a leader each, in any case."""

    def emit(key, ident):
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size, hot = np.diff(np.append(at, len(key))), shared_hot.value[0]
        take = np.repeat((size > 1) | (~rare_of(key[at].view(U64), hot) if len(hot) else False), size)
        return pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(ident[take]), pa.array(np.repeat(ident[at], size)[take])], names=["key", "id", "leader"])

    def run(batches):
        held = None
        for b in batches:
            key, ident = b.column(0).to_numpy(), b.column(1).to_numpy()
            if held is not None:
                key, ident = np.concatenate((held[0], key)), np.concatenate((held[1], ident))
            if not len(key):
                continue
            # a group that may go on in the next batch waits, unless it's already long: then it goes out, and its leader goes on
            cut = len(key) - int((key[::-1] == key[-1]).argmin() or len(key)) if (key != key[-1]).any() else 0
            if len(key) - cut > 100_000:
                yield emit(key, ident)
                held = key[cut : cut + 1], ident[cut : cut + 1]
                continue
            if cut:
                yield emit(key[:cut], ident[:cut])
            held = key[cut:], ident[cut:]
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def _hamming(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(FOLD)), F.lit(0))


def _may_link(na: Column, nb: Column, num: int, den: int, distance: Column) -> Column:
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (distance * (den + num) <= (na + nb) * (den - num))


class ParityJoin:
    """One join: parameters, the documents, and the tables that its steps share."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        whole_number_ids(docs, id_col)
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def digests(self, common) -> DataFrame:
        """id, n, the digests, excess, and the folded sketch of every document. The excesses of two linked sets add up to 0 at most, unless they share a rare shingle."""
        n, num, den = self.n, self.num, self.den

        def run(batch):
            for lo, hi, raw, offs in slices(batch.column(1)):
                size, d1, d2, fold, n_rare = _digest_rows(raw, offs, n, common.value)
                excess = n_rare * (den + num) - size * (den - num)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(excess), *(pa.array(fold[:, k].view(np.int64)) for k in range(FOLD))], names=["id", "n", "d1", "d2", "excess", *(f"s{k}" for k in range(FOLD))])

        return arrow_map(self.docs, run, "id long, n long, d1 long, d2 long, excess long, " + ", ".join(f"s{k} long" for k in range(FOLD)))

    def sample(self) -> DataFrame:
        return self.docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)

    def common(self) -> np.ndarray:
        """Hashes of shingles in many documents, by a sample; a bounded list that decides only which blocks make keys."""
        n = self.n

        def run(batch):
            for _, _, raw, offs in slices(batch.column(0)):
                k, c = np.unique(sets_of(raw, offs, n)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        return self._frequent(arrow_map(self.sample().select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))[0]

    def hot(self, reps: DataFrame, common) -> tuple[np.ndarray, np.ndarray]:
        """(keys of many documents, partitions to deal each to), by a sample of the representatives; a bounded list that decides only how keys are dealt."""
        some = self.keys(reps.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), common, None)
        h, c = self._frequent(some.groupBy(F.col("key").alias("h")).agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.col("c")))
        return h, np.clip(-(-c * SAMPLE // HOT_ROWS), 1, self.parts)

    def _frequent(self, counted: DataFrame) -> tuple[np.ndarray, ...]:
        """Columns of the bounded list, in the order of the hash."""
        counted = materialize(counted.where(F.col("c") >= COMMON_DOCS), "frequent")
        got = most_frequent(counted, "c", COMMON).toArrow()
        release(counted)
        order = np.argsort(got["h"].to_numpy().view(U64))
        return tuple((got[f].to_numpy().view(U64) if f == "h" else got[f].to_numpy())[order] for f in got.column_names if f != "c")

    def keys(self, docs: DataFrame, common, hot) -> DataFrame:
        """key, id, salt: a hot key's rows are dealt over partitions by salts."""
        n, num, den = self.n, self.num, self.den

        def run(batch):
            ids = batch.column(0).to_numpy()
            for lo, hi, raw, offs in slices(batch.column(1)):
                doc, key = block_keys(*sets_of(raw, offs, n), num, den, common.value)
                own, salt = ids[lo:hi][doc], np.zeros(len(key), np.int32)
                if hot is not None and len(hot.value[0]):
                    known, many = hot.value
                    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    at = np.flatnonzero(known[place] == key)
                    salt[at] = (mix(own[at].view(U64)) % many[place[at]].astype(U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(salt)], names=["key", "id", "salt"])

        return arrow_map(docs, run, "key long, id long, salt int")

    def sets(self, ids: DataFrame) -> DataFrame:
        n = self.n

        def run(batch):
            for lo, hi, raw, offs in slices(batch.column(1)):
                doc, h, size = sets_of(raw, offs, n)
                at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=["id", "shingles"])

        return arrow_map(by_ids(self.docs, ids, "left_semi", "id"), run, "id long, shingles array<long>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of materialized pairs (a, b), those that link. Each set is read once; a set with very many partners goes to several tasks."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
        sets = materialize(self.sets(ids), "sets")
        side = lambda x, s: sets.select(F.col("id").alias(x), F.col("shingles").alias(s))
        both = hot_join(pairs, side("a", "x"), ["a"], "b").join(side("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        links = both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u")).where(F.col("i") * self.den >= F.col("u") * self.num)
        out = materialize(links.select("a", "b").distinct(), "links")
        release(ids, sets)
        return out

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(digest rows of all documents, links between representatives). Both materialized."""
        context = self.docs.sparkSession.sparkContext
        common = context.broadcast(self.common())
        digests = materialize(self.digests(common), "digests")
        own = digests.where("n > 0 AND id IS NOT NULL")
        classes = materialize(own.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.count(F.lit(1)).alias("c")).where("rep < most"), "classes")
        self.copies = materialize(hot_join(own.select("id", "n", "d1", "d2"), classes.drop("most", "c"), ["d1", "d2", "n"], "id", classes).where("id <> rep").select("id", "rep").distinct(), "copies")
        release(classes)
        gone = self.copies.select("id").distinct()
        several = own.groupBy("id").agg((F.count_distinct("d1", "d2", "n") > 1).alias("differ")).where("differ").select("id")
        gone = gone.join(several, "id", "left_anti")  # an id with different texts stays, for one of them may be no copy
        gone = materialize(gone, "gone")
        sketch = by_ids(own, gone, "left_anti", "id").select("id", "n", "excess", *(f"s{k}" for k in range(FOLD)))
        reps = by_ids(self.docs.where("id IS NOT NULL"), gone, "left_anti", "id")
        hot = context.broadcast(self.hot(reps, common))
        keyed = self.keys(reps, common, hot)
        groups = materialize(keyed.repartition(self.parts, "key", "salt").sortWithinPartitions("key", "id").mapInArrow(_groups(hot), "key long, id long, leader long"), "groups")
        side = lambda x: sketch.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), *(F.col(f"s{k}").alias(f"{x}{k}") for k in range(FOLD)))

        found, labels, left, rows, state = [], None, 0, 0, None
        for turn in range(ROUNDS):
            # each row is tried against the leaders that it shares most keys with
            if turn == 0:
                tries = groups.where("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b"))
            else:
                if not left or (turn > 1 and left <= PAIRS_PER_ROW * rows):
                    break
                # rows outside a group's largest component against some of its members, the one with least excess first
                pick = [F.min_by(F.struct("id", "excess"), F.struct("excess", "id") if turn == 1 and not m else F.struct(F.xxhash64("id", F.lit(turn * LEADERS + m)), F.col("id"))) for m in range(LEADERS)]
                lead = state.where("NOT minor").groupBy("key").agg(F.array_distinct(F.array(*pick)).alias("l"))
                tries = hot_join(state.where("minor"), lead, ["key"], "id").select(F.explode("l.id").alias("a"), F.col("id").alias("b"))
            tries = materialize(self._nearest(tries.groupBy("a", "b").agg((-F.count(F.lit(1))).alias("rank"))), "tries")
            near = hot_join(tries, side("a"), ["a"], "b").join(side("b"), "b").where(_may_link(F.col("na"), F.col("nb"), self.num, self.den, _hamming("a", "b")))
            near = materialize(near.select("a", "b").distinct(), "near")
            release(tries)
            found.append(self.verified(near))
            release(near, labels, state)
            labels = components(_union(found))
            state, left, rows = self._open(groups, labels, sketch)
        if left:
            pairs = materialize(self._pairs(state, sketch), "pairs")
            found.append(self.verified(pairs))
            release(pairs)
        release(groups, labels, state, gone)
        return digests, _union(found)

    def _nearest(self, pairs: DataFrame) -> DataFrame:
        """Of each b the TRIES pairs of least rank; a row has a bounded number of keys, and as many leaders."""
        best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "a"))), 1, TRIES)
        return pairs.groupBy("b").agg(best.alias("m")).select("b", F.explode("m").alias("m")).select(F.col("m.a").alias("a"), "b")

    def _open(self, groups: DataFrame, labels: DataFrame, sketch: DataFrame) -> tuple[DataFrame, int, int]:
        """(rows of groups that several components share: key, id, label, excess, minor; pairs to compare in them; rows).

        minor: outside the group's largest component, whose members needn't be compared with each other. Of weak groups (odd keys) two rows with excess need no comparison.
        """
        rows = materialize(groups.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")).distinct(), "group-rows")
        each = materialize(rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")), "group-parts")
        several = each.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("c"), F.max_by("label", F.struct("m", "label")).alias("top")).where("parts > 1")
        several = materialize(several, "open-keys")
        state = hot_join(rows, several.select("key", "top"), ["key"], "id", several).join(sketch.select("id", "excess"), "id")
        state = state.withColumn("minor", F.col("label") != F.col("top")).drop("top").withColumn("excess", F.when(F.col("key") % 2 == 0, F.lit(-(1 << 40))).otherwise(F.col("excess"))).distinct()
        state = materialize(state, "open")
        some = state.groupBy("key").agg(F.count(F.lit(1)).alias("s"), F.sum(F.col("minor").cast("long")).alias("o"), F.sum((F.col("minor") & (F.col("excess") > 0)).cast("long")).alias("z"), F.sum((F.col("excess") <= 0).cast("long")).alias("p"))
        got = some.agg(F.coalesce(F.sum((F.col("o") - F.col("z")) * F.col("s") + F.col("z") * F.col("p")), F.lit(0)).alias("p"), F.coalesce(F.sum("s"), F.lit(0)).alias("r")).first()
        release(each, several, rows)
        return state, int(got["p"]), int(got["r"])

    def _pairs(self, state: DataFrame, sketch: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components in one group whose sketches may link: every minor row against the group, in cells, compared within the join."""
        zone = (F.col("excess") > 0).cast("int")
        full = state.join(sketch.drop("excess"), "id").withColumn("zone", zone)
        sides = state.withColumn("zone", zone).groupBy("key").agg(
            F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("ca"), F.ceil(F.greatest(F.sum(F.col("minor").cast("long")), F.lit(1)) / CELL).cast("int").alias("cb"))
        full = hot_join(materialize(full, "open-sketches"), sides, ["key"], "id")
        spread = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        half = lambda df, x, *cells: df.select(F.col("key").alias(f"k{x}"), F.col("id").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("excess").alias(f"e{x}"), *cells, *(F.col(f"s{k}").alias(f"{x}{k}") for k in range(FOLD)))
        # zone rows are compared with rows without excess only (tag 1); minor rows without excess with all (tag 0)
        tagged = full.withColumn("tag", F.explode(F.when(F.col("zone") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        x = half(tagged.withColumn("ia", spread("ca")).withColumn("ja", every("cb")), "a", F.col("tag").alias("ta"), "ia", "ja").repartition(self.parts, "ka", "ta", "ia", "ja")
        y = half(full.where("minor").withColumn("jb", spread("cb")).withColumn("ib", every("ca")), "b", F.col("zone").alias("tb"), "ib", "jb").repartition(self.parts, "kb", "tb", "ib", "jb")
        near = _may_link(F.col("na"), F.col("nb"), self.num, self.den, _hamming("a", "b"))
        on = (F.col("ka") == F.col("kb")) & (F.col("ta") == F.col("tb")) & (F.col("ia") == F.col("ib")) & (F.col("ja") == F.col("jb")) & (F.col("la") != F.col("lb")) & (F.col("ea") + F.col("eb") <= 0) & near
        return x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    join = ParityJoin(docs, n, num, den, id_col, text_col)
    digests, links = join.links()
    edges = links.unionByName(join.copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    labels = components(edges)
    kind = docs.schema[id_col].dataType.simpleString()
    out = digests.select("id", "n").join(labels, "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, of the smallest id of each component."""
    got = jaccard_components(docs, n, num, den, id_col, text_col)
    extra = materialize(got.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "near-copies")
    return by_ids(docs, extra, "left_anti", id_col)
