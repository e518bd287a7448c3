"""Jaccard join of word-shingle sets with adaptive multi-match prefixes, and the components of its links.

A document's tokens are the hashes of its distinct shingles. They are ordered rare ones first: those that more than
HELD sets hold ("common", by exact counts) come last, the others by their hash. Two sets similar enough share, for
every l, at least l tokens of their l-prefixes, where the l-prefix has l - 1 tokens more than the plain one. So each
document lengthens its prefix as far as that lowers the estimated cost of its candidates, which is taken from the
number of sets behind each token of the prefix, and a pair needs as many more shared tokens before it is verified on
the whole sets. Rare tokens alone are joined, so no token makes more than HELD * HELD / 2 pairs.

A document of which too few tokens are rare to fill a prefix ("dense") is found by other documents through its rare
tokens. Two dense ones are compared whole: those that share tokens of their prefixes form groups, groups are dealt into
blocks of bounded size, and each pair of blocks is compared in one task, which returns only links between classes.

Before that, equal sets become one node, and nodes with the same smallest tokens are verified against the first of
them. Pairs within a class already found are not compared, so a large group of near copies mostly costs its size.

Defined results: a null or empty text has no shingles and is linked with nothing; a text shorter than a shingle is one
shingle; a null doc_id is linked with nothing and has no component; repeated rows are in one component; rows with one
doc_id and different texts are judged by their own text; very long texts are read whole, in blocks; further columns are
not read; an empty table gives an empty result. Nothing is capped: each pair of different sets that reaches the limit
is a link and joins their components. The operator returns components, not the set of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components
from .scratch import BROADCAST_ROWS, among, discard, few, with_keys, written
from .textscan import LOWER, blocks, columns, hashed, mix, odd, shingles, words

N, PERCENT = 5, 75
#: Sets that may hold a token which is joined, and the weight of verifying a pair against reading a posting.
HELD, VERIFY = 48, 8
#: Weight of the sets in a block of dense documents: their tokens, and 64 for each.
BLOCK = 1 << 18
#: Bits of a posting's place in its prefix, below the document's number, the highest marking a dense document.
_POS = 24
_DENSE = 1 << (_POS - 1)
#: Tokens that a kernel hands on at once.
_TOGETHER = 1 << 17


def token_sets(column: pa.Array, n: int = N):
    """For each text its distinct shingles as sorted hashes."""
    for _, _, b, at in blocks(column):
        b = LOWER[b]
        start, end, row = words(b, at)
        word = hashed(b, start, end)
        h, first = shingles(word, row, n)
        cut, word_cut = np.searchsorted(row[first], np.arange(len(at))), np.searchsorted(row, np.arange(len(at)))
        for k in range(len(at) - 1):
            w = word[word_cut[k] : word_cut[k + 1]]
            if len(w) >= n:
                x = np.sort(h[cut[k] : cut[k + 1]])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif len(w):
                yield mix(np.array([np.sum(w * odd(len(w), 3)) + np.uint64(len(w))], np.uint64))
            else:
                yield w


def _sketches(batches):
    """Size, 128-bit key of the set, and hash of its three smallest tokens."""
    salt = odd(2, 5)
    for batch in batches:
        out = np.zeros((4, batch.num_rows), np.uint64)
        for k, x in enumerate(token_sets(batch.column("text"))):
            if len(x):
                out[:, k] = len(x), np.sum(mix(x ^ salt[0])), np.bitwise_xor.reduce(mix(x ^ salt[1])), mix(np.array([np.sum(x[:3] * odd(3, 9)[: len(x[:3])])]))[0]
        names = ("n", "ka", "kb", "sig")
        yield columns(doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), **{c: pa.array(v.view(np.int64)) for c, v in zip(names, out, strict=True)})


def _similar(percent: int):
    """The pairs of texts whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(token_sets(batch.column("ta")), token_sets(batch.column("tb")), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class _Common:
    """The common tokens with the numbers of their sets, sorted; `token` is None where they come as a column of each row."""

    def __init__(self, held: list[np.ndarray] | None):
        self.token, self.count = held or (None, None)

    def split(self, x: np.ndarray, own: pa.Scalar | None) -> tuple[np.ndarray, np.ndarray]:
        """x, sorted, as its rare tokens, and its common ones with the rarest first."""
        token, count = self.token, self.count
        if token is None:
            some = sorted((r["token"], r["k"]) for r in own.as_py() or ())
            token, count = np.array([t for t, _ in some], np.int64), np.array([k for _, k in some], np.int64)
        common, at = among(x.view(np.int64), token)
        y = x[common]
        return x[~common], y[np.lexsort((y, count[at]))]


def _rows(node: list[int], tokens: list[np.ndarray], **more: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each token, with its node."""
    per = np.repeat(np.array(node, np.int64), [len(t) for t in tokens])
    return columns(token=np.concatenate(tokens).view(np.int64), node=per, **{k: np.concatenate(v) for k, v in more.items()})


def _tokens(batches):
    """(token, node) of every token of every set."""
    for batch in batches:
        node, tokens, size = [], [], 0
        for k, x in zip(batch.column("node").to_pylist(), token_sets(batch.column("text")), strict=True):
            if size and size + len(x) > _TOGETHER:
                yield _rows(node, tokens)
                node, tokens, size = [], [], 0
            node.append(k)
            tokens.append(x)
            size += len(x)
        if size:
            yield _rows(node, tokens)


def _counts(batches):
    """(token, k): how many sets hold a token, in parts."""
    for batch in batches:
        some, size = [], 0
        for x in token_sets(batch.column("text")):
            some.append(x)
            size += len(x)
            if size >= _TOGETHER:
                token, k = np.unique(np.concatenate(some), return_counts=True)
                yield columns(token=token.view(np.int64), k=k)
                some, size = [], 0
        if size:
            token, k = np.unique(np.concatenate(some), return_counts=True)
            yield columns(token=token.view(np.int64), k=k)


def _prefixes(percent: int, common: _Common, dense: bool):
    """(token, node, pos): of documents with enough rare tokens the prefix and its slack, of dense ones all rare tokens.

    With `dense`, (token, node) of dense documents' plain prefixes, common tokens included, instead."""

    def run(batches):
        for batch in batches:
            own = batch.column("common") if common.token is None else [None] * batch.num_rows
            nodes = batch.column("node").to_pylist()
            node, tokens, places, size = [], [], [], 0
            for k, x in enumerate(token_sets(batch.column("text"))):
                rare, rest = common.split(x, own[k])
                plain = prefix(len(x), percent)
                reach = plain + slack(plain)
                assert reach < _DENSE
                is_dense = len(rare) < min(reach, len(x))
                if dense and not is_dense or not len(x):
                    continue
                out = np.concatenate((rare, rest))[:plain] if dense else rare[:reach]
                node.append(nodes[k])
                tokens.append(out)
                places.append(np.arange(len(out), dtype=np.int32) + is_dense * _DENSE)
                size += len(out)
                if size >= _TOGETHER:
                    yield _rows(node, tokens) if dense else _rows(node, tokens, pos=places)
                    node, tokens, places, size = [], [], [], 0
            if size:
                yield _rows(node, tokens) if dense else _rows(node, tokens, pos=places)

    return run


def _merging(sets: list[np.ndarray], cls: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int):
    """Links (a, b) between classes among sets[left] x sets[right], or within left; cls is merged on the way.

    A set is marked in an array of all tokens and met with all others at once. Members of the largest class are not
    compared with each other."""
    n = np.array([len(x) for x in sets])
    ids, cut = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate(([0], np.cumsum(n)))
    tokens = [ids[cut[k] : cut[k + 1]] for k in range(len(sets))]
    mark = np.zeros(len(ids), np.uint8)
    names, sizes = np.unique(cls, return_counts=True)
    big = cls == names[np.argmax(sizes)]
    turns = [(left[~big[left]], left)] if right is None else [(left[~big[left]], right), (right[~big[right]], left[big[left]])]
    for one, other in turns:
        if not len(one) or not len(other):
            continue
        flat = np.concatenate([tokens[k] for k in other])
        at = np.concatenate(([0], np.cumsum(n[other])[:-1]))
        for k in one:
            apart = cls[other] != cls[k]
            if not apart.any():
                continue
            mark[tokens[k]] = 1
            both = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[tokens[k]] = 0
            for j in other[apart & (100 * both >= percent * (n[k] + n[other] - both))]:
                if cls[j] != cls[k]:
                    yield k, j
                    cls[cls == cls[j]] = cls[k]


def _compared(percent: int):
    """For the rows (grp, side, node, comp, text) of a task the links (a, b) that merge classes."""

    def run(rows: pa.Table) -> pa.Table:
        sets = list(token_sets(rows.column("text")))
        grp, side, node, comp = (rows.column(c).to_numpy() for c in ("grp", "side", "node", "comp"))
        order, found = np.argsort(grp, kind="stable"), [np.zeros((0, 2), np.int64)]
        for part in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            one = side[part] == 0
            left, right = np.flatnonzero(one), None if one.all() else np.flatnonzero(~one)
            links = list(_merging([sets[k] for k in part], comp[part], left, right, percent))
            found.append(node[part[np.array(links, np.int64).reshape(-1, 2)]])
        links = np.concatenate(found)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def slack(plain):
    """Tokens by which a prefix may be lengthened. For numbers and, as SQL, for columns."""
    return f"(4 + {plain} div 8)" if isinstance(plain, str) else 4 + plain // 8


def prefix(n, percent: int = PERCENT):
    """Length of the plain prefix of a set of n: n - ceil(percent * n / 100) + 1. For numbers and, as SQL, for columns."""
    return f"({n} - ({n} * {percent} + 99) div 100 + 1)" if isinstance(n, str) else n - (n * percent + 99) // 100 + 1


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with `i`: 0, 1, ... without gaps, from each part's rows and the count of rows in the parts before."""
    parts = written(df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")  # one row per part
    return written(parts.join(F.broadcast(before), "_part").withColumn("i", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before"))


def _near_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class Join:
    """Links between the sets of documents of one table."""

    def __init__(self, docs: DataFrame, n: int = N, percent: int = PERCENT, held: int = HELD, block: int = BLOCK, broadcast: int = BROADCAST_ROWS):
        assert n == N
        self.docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
        self.percent, self.held, self.block, self.broadcast = percent, held, block, broadcast

    def texts(self, ids: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ids, each read from the one row that stands for its set."""
        rows = written(with_keys(self.nodes.select("node", "doc_id", "text_key"), ids, "node"))
        return with_keys(self.docs, rows, ["doc_id", "text_key"]).select("node", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole texts are similar enough, written. Texts travel, as they are smaller than their sets."""
        ids = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        texts = self.texts(ids)
        a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        out = written(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_similar(self.percent), "a long, b long"))
        discard(ids, pairs)
        return out

    def node_texts(self) -> DataFrame:
        return with_keys(self.docs, self.nodes.select("node", "doc_id", "text_key"), ["doc_id", "text_key"]).select("node", "text")

    def with_common(self) -> tuple[DataFrame, _Common]:
        """The nodes' texts, and the tokens that more than `held` sets hold: beside them if few, else as a column.

        Every token is shuffled once to be counted. Kernels add up what they have together, which is enough for tokens
        that many sets hold; partial counts by Spark would not pay, as most tokens occur once."""
        texts = self.node_texts()
        counted = texts.mapInArrow(_counts, "token long, k long").repartition("token").groupBy("token").agg(F.sum("k").alias("k"))
        common = written(counted.where(F.col("k") > self.held))
        if (held := few(common.select("token", "k"), self.broadcast)) is not None:
            return texts, _Common(held)
        tokens = texts.mapInArrow(_tokens, "token long, node long").join(common, "token")
        by_node = tokens.groupBy("node").agg(F.collect_list(F.struct("token", "k")).alias("common"))
        return texts.join(by_node, "node", "left"), _Common(None)

    def candidates(self, texts: DataFrame, common: _Common, placed: DataFrame) -> DataFrame:
        """Pairs of nodes of different classes, not both dense, that share enough rare tokens of their prefixes."""
        w = W.partitionBy("token")
        rows = texts.mapInArrow(_prefixes(self.percent, common, False), "token long, node long, pos int")
        rows = rows.select("token", (F.shiftleft("node", _POS) + F.col("pos")).alias("ref"))  # packed, as rows here are many
        twice = rows.repartition("token").withColumn("k", F.count("*").over(w)).where("k > 1")
        twice = twice.select("token", F.shiftright("ref", _POS).alias("node"), F.col("ref").bitwiseAND((1 << _POS) - 1).cast("int").alias("pos"), "k")
        apart = with_keys(twice, placed, "node").withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).where("lo < hi")
        dense = F.col("pos") >= _DENSE
        shared = written(apart.select("token", F.col("node").alias("doc"), "comp", "n", "k", dense.alias("dense"), F.when(dense, F.col("pos") - _DENSE).otherwise(F.col("pos")).alias("pos")))
        # Lengthening as far as the next token that others hold costs nothing, so these are the lengths to choose from.
        plain = prefix("n", self.percent)
        before = F.coalesce(F.sum(F.col("k") - 1).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cost = lambda read, e: read * (1 + F.lit(VERIFY) / (e + 1))
        lengths = shared.where("not dense").withColumn("e", F.expr(f"pos - {plain}")).withColumn("before", before)
        most = F.expr(f"cast({slack(plain)} as int)")
        best = lengths.groupBy("doc", "n").agg(
            F.min(F.when(F.col("e") >= 0, F.struct(cost(F.col("before"), F.col("e")).alias("cost"), F.col("e").cast("int").alias("e")))).alias("best"), F.sum(F.col("k") - 1).alias("all"),
        )
        extra = F.least(F.col("best"), F.struct(cost(F.col("all"), most).alias("cost"), most.alias("e")))["e"]
        plans = written(best.select("doc", F.least(extra, F.expr(f"cast(n - {plain} as int)")).alias("extra")))
        rows = shared.join(plans, "doc", "left").where(F.col("dense") | F.expr(f"pos < {plain} + extra"))
        rows = rows.select("token", "doc", "comp", "n", "dense", F.when(F.col("dense"), F.col("n")).otherwise(F.col("extra")).cast("int").alias("extra"))
        pairs = written(self.met(self.across(rows)))
        discard(shared, plans)
        return pairs

    def across(self, x: DataFrame) -> DataFrame:
        """Pairs of rows with one token, of different classes and sizes near enough, not both dense."""
        y = x.select("token", *(F.col(c).alias(f"{c}_y") for c in x.columns if c != "token"))
        return x.join(y, "token").where((F.col("doc") < F.col("doc_y")) & (F.col("comp") != F.col("comp_y")) & ~(F.col("dense") & F.col("dense_y")) & _near_size("n", "n_y", self.percent))

    def met(self, both: DataFrame) -> DataFrame:
        """Pairs (a, b) with more shared tokens than the smaller extra, and enough for the limit.

        Of the document whose prefix ends first every token up to there is compared, and of a dense one every rare token
        is, so the overlap is at most the tokens met and what lies beyond the other's prefix (`room`)."""
        room = lambda c: F.when(F.col(f"dense{c}"), -1).otherwise(F.expr(f"n{c} - {prefix('n' + c, self.percent)} - extra{c}"))
        per = both.groupBy(F.col("doc").alias("a"), F.col("doc_y").alias("b")).agg(F.count("*").alias("c"), F.first(F.struct((F.col("n") + F.col("n_y")).alias("sizes"), F.greatest(room(""), room("_y")).alias("room"), F.least("extra", "extra_y").alias("extra"))).alias("p"))
        return per.where(f"c > p.extra and (c + p.room) * {100 + self.percent} >= {self.percent} * p.sizes").select("a", "b")

    def dense_links(self, texts: DataFrame, common: _Common, placed: DataFrame) -> DataFrame:
        """Links between classes of dense documents, each pair of which is compared if prefixes and sizes allow one."""
        edges = rows = written(texts.mapInArrow(_prefixes(self.percent, common, True), "token long, node long"))
        hubs = rows.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
        groups = components(written(rows.join(hubs, "token").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
        members = written(with_keys(groups.withColumnRenamed("root", "grp"), placed, "node"))
        discard(edges)
        # Linked sizes are in one bucket or in neighbouring ones.
        members = members.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.percent * 1.01))).cast("int"))
        weight = F.sum(F.col("n") + 64)
        mixed = members.groupBy("grp").agg(weight.alias("whole"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")
        members = written(members.join(mixed, "grp"))
        small = members.where(F.col("whole") <= self.block)
        bins = F.lit(1 + (small.agg(weight).first()[0] or 0) // self.block)
        alone = small.select(F.struct(F.pmod(F.xxhash64("grp"), bins).alias("grp"), *(F.lit(-1).alias(c) for c in ("p", "i", "q", "j"))).alias("task"), F.lit(0).alias("side"), "grp", "node", "comp")
        large = members.where(F.col("whole") > self.block)
        blocks = large.groupBy("grp", "bucket").agg(F.ceil(weight / self.block).cast("int").alias("blocks"))
        upper = blocks.select("grp", F.col("bucket").alias("q"), F.col("blocks").alias("others"))
        pairs = blocks.withColumnRenamed("bucket", "p").join(upper, "grp").where("q = p or q = p + 1")
        pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where("p < q or i <= j")
        task = F.struct("grp", "p", "i", "q", "j").alias("task")
        sides = pairs.select(task, F.lit(0).alias("side"), "grp", F.col("p").alias("bucket"), F.col("i").alias("part"))
        sides = sides.union(pairs.where("p < q or i < j").select(task, F.lit(1), "grp", "q", "j"))
        dealt = large.join(blocks, ["grp", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        dealt = dealt.join(sides, ["grp", "bucket", "part"]).select("task", "side", "grp", "node", "comp")
        rows = written(alone.union(dealt))
        texts = self.texts(written(members.select("node").distinct()))
        found = rows.join(texts, "node").select("task", "side", "grp", "node", "comp", "text").groupBy("task").applyInArrow(_compared(self.percent), "a long, b long")
        out = written(found.distinct())
        discard(rows, members)
        return out

    def classed(self, links: DataFrame) -> DataFrame:
        """(node, n, comp), written, by the links found so far."""
        return written(self.nodes.join(components(links), "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp")))

    def once(self, meta: DataFrame) -> DataFrame:
        """The documents without repeated rows. Only texts that are repeated are shuffled for it."""
        twice = written(meta.groupBy("doc_id", "text_key").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null").drop("k"))
        n, on = twice.count(), ["doc_id", "text_key"]
        if not n:
            return self.docs
        return with_keys(self.docs, twice, on, "left_anti", n).unionByName(with_keys(self.docs, twice, on, "left_semi", n).dropDuplicates(on))

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, set_id, component_id, text_key) of each row; text_key is a hash of its text."""
        meta = written(self.docs.mapInArrow(_sketches, "doc_id long, text_key long, n long, ka long, kb long, sig long"))
        self.docs = self.once(meta)
        # One number for each set, and the row that stands for it: doc_id alone does not tell texts apart.
        sets = meta.where("n > 0 and doc_id is not null").groupBy("ka", "kb").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.max("n").alias("n"), F.max("sig").alias("sig"))
        nodes = self.nodes = numbered(sets.select("ka", "kb", "row.*", "n", "sig")).withColumnRenamed("i", "node")
        hubs = nodes.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1")
        stars = nodes.join(hubs, "sig").where((F.col("node") != F.col("hub.node")) & _near_size("n", "hub.n", self.percent))
        links = self.verified(written(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))))
        placed = self.classed(links)
        texts, common = self.with_common()
        links = written(links.union(self.dense_links(texts, common, placed)).union(self.verified(self.candidates(texts, common, placed))))
        roots = components(links)
        least = written(nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("least")))
        named = with_keys(roots, least, "root").select("node", "least")
        of_set = nodes.join(named, "node", "left").select("ka", "kb", F.col("doc_id").alias("set_id"), F.coalesce("least", "doc_id").alias("least"))
        out = meta.join(of_set, ["ka", "kb"], "left")
        alone = (F.col("n") == 0) | F.col("doc_id").isNull()
        return out.select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "text_key",
        )


def linked(docs: DataFrame, **parameters: int) -> DataFrame:
    return Join(docs, **parameters).run()


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
m AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS set_id, s FROM s),
t AS (SELECT doc_id, n, unnest(s) AS tok FROM m WHERE doc_id = set_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT set_id AS d, set_id AS v FROM m UNION SELECT r.d, e.b FROM r JOIN e ON r.v = e.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, set_id, (SELECT min(v) FROM r WHERE r.d = m.set_id) AS component_id FROM m
"""
